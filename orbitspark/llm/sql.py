"""SQL of the operators that SQL can express. Every statement works on the whole table; the engines differ in speed alone."""

OP4 = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
s as (select distinct doc_id, array_to_string(words[pos:pos + 3], ' ') as sh from (select doc_id, words, unnest(range(1, greatest(2, len(words) - 2))) as pos from w where len(words) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
r as (select doc_id as node, doc_id as seen from documents union select r.node, l.b from r join l on l.a = r.seen)
select node as doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(seen) as component_id, min(seen) = node as kept from r left join n on n.doc_id = node group by node
"""

OP9 = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
p as (select doc_id, unnest(range(1, len(words) - 33)) as pos, words from w where len(words) >= 35),
g as (select doc_id, pos, array_to_string(words[pos:pos + 34], ' ') as win from p),
r as (select doc_id, pos from g where win in (select win from g group by win having count(*) > 1)),
c as (select distinct doc_id, unnest(range(pos, pos + 35)) as pos from r),
k as (select w.doc_id, len(w.words) as n, list_filter(range(1, len(w.words) + 1), lambda i: not list_contains(coalesce(x.gone, []), i)) as kept, w.words, coalesce(len(x.gone), 0) as lost
  from w left join (select doc_id, list(pos) as gone from c group by doc_id) x using (doc_id))
select doc_id, n::bigint as n_words, lost::bigint as n_removed, sha256(array_to_string(list_transform(kept, lambda i: words[i]), ' ')) as kept_sha256 from k
"""

OP10 = r"""
with t as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
g as (select doc_id, pos, substr(h, 2 * pos + 1, 100) as s from (select doc_id, h, unnest(range(0, length(h) // 2 - 49)) as pos from t where length(h) >= 100)),
f as (select s, min(doc_id) as first from g group by s having count(*) > 1),
r as (select g.doc_id, g.pos, case when g.pos <= max(g.pos) over (partition by g.doc_id order by g.pos rows between unbounded preceding and 1 preceding) + 50 then 0 else 1 end as new from g join f using (s) where f.first < g.doc_id),
q as (select doc_id, pos, sum(new) over (partition by doc_id order by pos) as run from r),
x as (select doc_id, run, min(pos) as a, max(pos) + 50 as b from q group by 1, 2),
y as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as from_ from x),
z as (select doc_id, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' order by a) as head, max(b) as last, sum(b - a) as gone, count(*) as spans from y join t using (doc_id) group by doc_id)
select t.doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256 from t left join z using (doc_id)
"""

OP12 = r"""
with p as (select row_number() over () as i, coalesce(lang, 'und') as lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
g as (select lang, array_to_string(ws[pos:pos + k - 1], ' ') as phrase, k from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as pos from w, range(1, 4) t(k) where len(ws) >= k)),
f as materialized (select lang, phrase, any_value(k) as size, count(*) as f from g group by 1, 2),
n as (select lang, sum(f)::bigint as n from f where size = 1 group by 1),
h as materialized (select * from f where f >= 10),
c as (select lang, phrase, size, f as a, string_split(phrase, ' ') as ws from h where size > 1),
q as (select c.*, k, x.f as l, y.f as r, (1000000::hugeint * a * a) // (x.f::hugeint * y.f) as score
  from (select *, unnest(range(1, size)) as k from c) c
  join h x on x.lang = c.lang and x.phrase = array_to_string(c.ws[1:k], ' ')
  join h y on y.lang = c.lang and y.phrase = array_to_string(c.ws[k + 1:], ' ')),
m as (select * from q qualify row_number() over (partition by lang, phrase order by score, k) = 1),
d as (select distinct s.lang, s.phrase from c s join (select lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) as inner_ from c where size = 3) t
  on t.lang = s.lang and t.inner_ = s.phrase where 100 * t.a >= 50 * s.a),
o as (select m.*, row_number() over (partition by m.lang order by score desc, a desc, encode(phrase)) as rank from m anti join d using (lang, phrase))
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from o join n using (lang) where rank <= 2000
"""
