"""SQL for the queries of near duplicates, licences, passages and language models."""

from __future__ import annotations

from . import license_scan
from .ngram_score import MU

_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Classes of texts of which each is linked by a weighted Jaccard of five-word shingles of 0.8 or more.
NEAR = f"""
with recursive d as (select doc_id, row_number() over (order by doc_id) as rid, {_WORDS} as w from documents),
node as (select w, min(rid) as node from d group by w),
s as (select node, case when len(w) <= 5 then array_to_string(w, ' ') else array_to_string(w[i : i + 4], ' ') end as g
      from (select node, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from node where len(w) > 0)),
c as (select node, g, count(*) as n from s group by 1, 2),
size as (select node, sum(n) as n from c group by 1),
pair as (select a.node as a, b.node as b, sum(least(a.n, b.n)) as met from c a join c b on a.g = b.g and a.node < b.node
         join size x on x.node = a.node join size y on y.node = b.node where least(x.n, y.n) >= 0.8 * greatest(x.n, y.n) - 1e-9 group by 1, 2),
link as (select a, b from pair join size x on x.node = a join size y on y.node = b where cast(met as double) / cast(x.n + y.n - met as double) >= 0.8),
two as (select a, b from link union all select b, a from link),
reach(a, b) as (select node, node from node union select r.a, two.b from reach r join two on two.a = r.b),
comp as (select a as node, min(b) as comp from reach group by 1),
m as (select doc_id, rid, comp from d join node using (w) join comp using (node))
select doc_id, min(doc_id) over (partition by comp) as class_id, count(*) over (partition by comp) as class_size,
       row_number() over (partition by comp order by doc_id, rid) = 1 as kept from m
"""

#: Bytes covered by strings of 400 bytes that start elsewhere too; the strings are compared by a 64-bit hash.
REPEATS = """
with d as (select doc_id, row_number() over () as rid, encode(coalesce(text, '')) as b from documents),
w as (select rid, i, hash(b[i : i + 399]) as h from (select rid, b, unnest(range(1, octet_length(b) - 398)) as i from d where octet_length(b) >= 400)),
s as (select rid, i from w semi join (select h from w group by h having count(*) > 1) t on t.h = w.h),
j as (select rid, i, case when i - lag(i) over (partition by rid order by i) <= 400 then 0 else 1 end as new from s),
r as (select rid, min(i) as a, max(i) + 400 as e from (select rid, i, sum(new) over (partition by rid order by i) as run from j) group by rid, run),
k as (select rid, a, coalesce(lag(e) over (partition by rid order by a), 1) as z, e from r),
g as (select k.rid, sum(e - a) as gone, count(*) as spans, max(e) as last, string_agg(case when a > z then hex(b[z : a - 1]) else '' end, '' order by a) as head
      from k join d on d.rid = k.rid group by k.rid)
select doc_id, cast(octet_length(b) as bigint) as n_bytes, cast(coalesce(gone, 0) as bigint) as n_removed, coalesce(spans, 0) as n_spans,
       sha256(case when g.rid is null then b else unhex(head || case when last <= octet_length(b) then hex(b[last : octet_length(b)]) else '' end) end) as kept_sha256,
       coalesce(gone, 0) > 0 as repeats
from d left join g on g.rid = d.rid
"""

#: Losses of two word bigram models.
LOSSES = f"""
with d as (select doc_id, row_number() over () as rid, {_WORDS} as w from documents),
near as (select distinct doc_id from labels where quality = 1),
t as (select rid, doc_id in (select doc_id from near) as hit, unnest(w) as c, unnest(range(len(w))) as i from d),
b as (select *, lag(c) over (partition by rid order by i) as p from t),
one as (select c, count(*) as n, count(*) filter (where hit) as t from t group by c),
two as (select p, c, count(*) as n, count(*) filter (where hit) as t from b group by p, c),
every as (select count(*) as v, sum(n) as n, sum(t) as t from one),
first as (select count(*) filter (where p is null) as n, count(*) filter (where p is null and hit) as t from b),
loss as (
  select rid, -log2((two.t + {MU} * ((one.t + {MU} / v) / (every.t + {MU}))) / (case when b.p is null then first.t else before.t end + {MU})) as lt,
         -log2((two.n + {MU} * ((one.n + {MU} / v) / (every.n + {MU}))) / (case when b.p is null then first.n else before.n end + {MU})) as lb
  from b join one on one.c = b.c join two on two.c = b.c and two.p is not distinct from b.p left join one before on before.c = b.p, every, first),
m as (select rid, avg(lt) as lt, avg(lb) as lb from loss group by rid)
select doc_id, cast(len(w) as bigint) as n_tokens, round(lt, 6) as loss_target, round(lb, 6) as loss_background, round(lt - lb, 6) as ce_diff from d left join m using (rid)
"""


def _rows(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def licences() -> str:
    """Base phrases, and every template at every relative position of every file: no look-up, no rare words."""
    known = license_scan.templates()
    template = [(k, t.label, i, w, int(i in t.key), len(t.key), t.least) for k, t in enumerate(known) for i, w in enumerate(t.words)]
    return f"""
with d as (select doc_id, row_number() over () as rid, {_WORDS} as w from documents),
t as (select rid, unnest(w) as c, unnest(range(len(w))) as i from d),
base(phrase, label, size) as (values {_rows([(p, label, len(p.split())) for p, label in license_scan.BASE])}),
spot as (select rid, i, label from (select rid, i, c, lead(c) over x as c1, lead(c, 2) over x as c2 from t window x as (partition by rid order by i)) q
          join base on phrase = case size when 2 then c || ' ' || c1 else c || ' ' || c1 || ' ' || c2 end),
told as (select rid, count(*) as n, min(i) as a, max(i) as z, list_sort(list_distinct(list(label))) as labels from spot group by rid),
tpl(k, label, place, c, is_key, keys, least) as (values {_rows(template)}),
weight as (select c, ln(1 + (select count(*) from d) / greatest(1, coalesce(df, 0))) as weight from (select distinct c from tpl) v left join (select c, count(distinct rid) as df from t group by c) using (c)),
whole as (select k, sum(weight) as whole from tpl join weight using (c) group by 1),
shift as (select t.rid, k, label, keys, least, i - place as shift, sum(weight) as got, sum(is_key) as met from t join tpl using (c) join weight using (c) group by 1, 2, 3, 4, 5, 6),
passed as (select rid, list(label) as labels, max(least(1.0, got / whole)) as score from shift join whole using (k) where met = keys and got / whole >= least - 1e-9 group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(told.n, 0) as n_base, told.a as first_word, told.z as last_word, coalesce(array_to_string(told.labels, ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(told.labels, []), coalesce(passed.labels, [])))), ','), '') as labels,
       round(cast(case when told.n > 0 then 1.0 else coalesce(passed.score, 0.0) end as double), 6) as score
from d left join told using (rid) left join passed using (rid)
"""


#: Articles of pages of the tables' make: one article element of headings and paragraphs.
ARTICLES = r"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) as a from pages),
b as (select page_id, url, list_transform(regexp_split_to_array(a, '</?(?:p|h1)>'), lambda x: regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g')) as b from a),
c as (select page_id, url, list_transform(b, lambda x: regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&amp;?', '&', 'g')) as c from b),
d as (select page_id, url, list_filter(list_transform(c, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') as d from c)
select page_id, url, array_to_string(d, chr(10) || chr(10)) as text, cast(length(array_to_string(d, chr(10) || chr(10))) as bigint) as n_chars from d
"""


def balls(k: int = 8, rounds: int = 10, seed: str = "3", dims: int = 64, scale: int = 1024) -> str:
    """Plain k-means: every vector against every centroid in each round."""
    steps = [f"""
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as v from embeddings
           where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dims}),
c0 as (select row_number() over (order by h, v) - 1 as c, v as m from (select sha256(concat('{seed}:', vec_id)) as h, v from v order by h, v limit {k}))"""]
    near = "select r, vec_id, v, c, m, d from (select r, vec_id, v, c, m, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from rows, c{0}) qualify row_number() over (partition by r order by d, c) = 1"
    steps.append("rows as (select row_number() over () as r, vec_id, v from v)")
    for t in range(rounds):
        steps.append(f"a{t} as ({near.format(t)})")
        steps.append(f"""s{t} as (select c, i, sum(x) as s, count(*) as n from (select c, unnest(v) as x, unnest(range({dims})) as i from a{t}) group by c, i),
m{t} as (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as m from s{t} group by c),
c{t + 1} as (select c, coalesce(m{t}.m, c{t}.m) as m from c{t} left join m{t} using (c))""")
    steps.append(f"z as ({near.format(rounds)})")
    return ",\n".join(steps) + """
select vec_id, cast(c as int) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
       sha256(array_to_string(m, ',')) as centroid_sha256 from z"""


#: Fill-in-middle by the prefix sums of token lengths, cut out of the text; the restored text is rebuilt from the output by places.
MIDDLES = r"""
with t as (select doc_id, coalesce(text, '') as s, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as w, sha256(concat('42:', doc_id)) as h from documents),
h as (select doc_id, s, list_transform(w, lambda x: length(x)) as size, len(w) as n, list_transform([0, 1, 2, 3], lambda k: cast('0x' || h[8 * k + 1 : 8 * k + 8] as bigint)) as h from t),
p as (select *, coalesce(list_sum(size[1 : least(h[1] % (n + 1), h[2] % (n + 1))]), 0) as a, coalesce(list_sum(size[1 : greatest(h[1] % (n + 1), h[2] % (n + 1))]), 0) as z,
             case when s = '' or regexp_matches(s, '<[PSM]>') or h[3] % 100 >= 50 then 'plain' when h[4] % 100 < 80 then 'spm' else 'psm' end as form from h),
o as (select *, case form when 'plain' then s when 'psm' then concat('<P>', s[1 : a], '<S>', s[z + 1 :], '<M>', s[a + 1 : z]) else concat('<S>', s[z + 1 :], '<P>', s[1 : a], '<M>', s[a + 1 : z]) end as o from p)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(a as bigint) end as prefix_chars, case when form <> 'plain' then cast(z - a as bigint) end as middle_chars,
       sha256(o) as output_sha256,
       sha256(case form when 'plain' then o when 'psm' then concat(o[4 : 3 + a], o[10 + a + length(s) - z :], o[7 + a : 6 + a + length(s) - z])
              else concat(o[7 + length(s) - z : 6 + length(s) - z + a], o[10 + length(s) - z + a :], o[4 : 3 + length(s) - z]) end) as restored_sha256
from o
"""
