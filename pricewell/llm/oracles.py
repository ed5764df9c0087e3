"""DuckDB SQL of the operators' queries, where SQL can express them in reasonable time."""

from __future__ import annotations

from . import linededup

MIX = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))), 1, 10))::bigint as h from documents),
s as (
  select source, sum(size)::bigint as source_size, 2.0::double * sum(size) as cap, ([3.0, 1.0, 2.0])[(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as w from d group by source),
o as (select *, row_number() over (order by cap / w, source nulls last) as place, 1.5::double * sum(source_size) over () as total from s),
l as (
  select *, (total - coalesce(sum(cap) over (order by place rows between unbounded preceding and 1 preceding), 0)) / (sum(w) over () - coalesce(sum(w) over (order by place rows between unbounded preceding and 1 preceding), 0)) as level from o),
f as (select source, source_size, coalesce(least(cap, (select arg_min(level, place) from l where level < cap / w) * w), cap) as target from l),
p as (select *, case when source_size > 0 then floor(target / source_size) else 1 end as whole, greatest(0, target - (case when source_size > 0 then floor(target / source_size) else 1 end) * source_size) as rest from f),
c as (select doc_id, source, size, coalesce(sum(size) over (partition by source order by h, doc_id rows between unbounded preceding and 1 preceding), 0) as before from d)
select c.doc_id, c.size::bigint as size, p.source_size, p.target,
  (c.size * (p.whole + case when p.whole < 2 and (c.before + c.size <= p.rest or (c.before <= p.rest and c.before + c.size - p.rest < p.rest - c.before)) then 1 else 0 end))::bigint as taken
from c join p on c.source is not distinct from p.source"""

_WORDS = r"list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: x)"

SUBSTRING = rf"""
with d as (select doc_id, {_WORDS} as w from documents),
win as (select doc_id, i as pos, array_to_string(w[i:i + 19], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d)),
again as (select doc_id, pos from win qualify row_number() over (partition by k order by doc_id, pos) > 1),
gone as (select distinct doc_id, i from (select doc_id, unnest(range(pos, pos + 20)) as i from again)),
each as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d),
kept as (select e.doc_id, string_agg(e.word, ' ' order by e.i) as t, count(*) as n from each e anti join gone g on g.doc_id = e.doc_id and g.i = e.i group by e.doc_id)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)"""

_PLAIN = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"

DECONTAMINATE = rf"""
with i as (select item_id, {_PLAIN} as w from benchmark),
iw as (select item_id, m, array_to_string(w[j:j + m - 1], ' ') as k from (select item_id, w, least(10, len(w)) as m, unnest(range(1, len(w) - least(10, len(w)) + 2)) as j from i where len(w) > 0)),
keys as (select distinct m, k, item_id from iw),
d as (select doc_id, {_PLAIN} as w from documents),
dw as (select doc_id, m, j, array_to_string(w[j:j + m - 1], ' ') as k from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as j from d cross join (select distinct m from keys))),
hit as (select doc_id, m, j, item_id from dw join keys using (m, k)),
places as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(j, j + m)) as p from hit) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as ids from (select distinct doc_id, item_id::varchar as x from hit) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join places using (doc_id) left join items using (doc_id)"""

NEAR = r"""
with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, g from (select doc_id, case when len(w) = 1 then [w[1]] else list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1]) end as gs from t where len(w) > 0) x, unnest(gs) u(g)),
n as (select doc_id, count(*) as n from s group by doc_id),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from pair join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
ways as (select a, b from link union all select b, a from link),
reach(doc_id, r) as (select doc_id, doc_id from t union select reach.doc_id, ways.b from reach join ways on ways.a = reach.r),
c as (select doc_id, min(r) as component_id from reach group by doc_id)
select t.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, t.doc_id = component_id as kept from t left join n using (doc_id) join c using (doc_id)"""

SUFFIX = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
win as (select doc_id, p, md5(substr(x, (2 * p - 1)::bigint, 400)) as k from (select doc_id, x, unnest(range(1, len(x) // 2 - 198)) as p from d)),
twice as (select doc_id, p from win qualify count(*) over (partition by k) > 1),
edge as (select doc_id, p, coalesce(p - lag(p) over (partition by doc_id order by p) > 200, true) as opens from twice),
grp as (select doc_id, p, sum(opens::int) over (partition by doc_id order by p) as g from edge),
span as (select doc_id, min(p) as a, max(p) + 200 as z from grp group by doc_id, g),
gap as (select d.doc_id, x, list(span.a order by span.a) as s, list(span.z order by span.a) as e from d left join span using (doc_id) group by d.doc_id, x)
select doc_id, (len(x) // 2)::bigint as n_bytes, coalesce(list_sum(list_transform(range(1, len(s) + 1), lambda i: e[i] - s[i])), 0)::bigint as n_removed, case when s[1] is null then 0 else len(s) end::bigint as n_spans,
  sha256(unhex(case when s[1] is null then x else array_to_string(list_transform(range(0, len(s) + 1), lambda i: substr(x, (case when i = 0 then 1 else 2 * e[i] - 1 end)::bigint, (2 * (case when i = len(s) then len(x) // 2 + 1 else s[i + 1] end) - 1 - case when i = 0 then 1 else 2 * e[i] - 1 end)::bigint)), '') end)) as kept_sha256
from gap"""

#: CRC-32 of 16 bytes by its linearity: `e` has what bit `k` of a byte adds at each distance from the end, and (k = 8) what the initial value adds.
_CRC = """
tab(n, k, c) as (select n::bigint, 0, n::bigint from range(256) r(n) union all select n, k + 1, xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end) from tab where k < 8),
t as (select n, c from tab where k = 8),
e(d, k, v) as (
  select 0::bigint, k, c from (select log2(n)::int as k, c from t where n in (1, 2, 4, 8, 16, 32, 64, 128) union all select 8, 4294967295)
  union all select d + 1, k, xor(v >> 8, t.c) from e join t on t.n = v & 255 where d < 16),
"""


_LITTLE = "printf('%02X%02X%02X%02X', {n} & 255, ({n} >> 8) & 255, ({n} >> 16) & 255, ({n} >> 24) & 255)"

MEDIA = f"""
with recursive {_CRC}
w as (select doc_id, octet_length(encode(coalesce(text, '')))::bigint as n, coalesce(text, '') as x from documents),
o as (select doc_id, n, greatest(192, (n + 191) // 192 * 192) as m, hex(encode(x || repeat(' ', (greatest(192, (n + 191) // 192 * 192) - n)::bigint))) as h from w),
a as materialized (select doc_id, i, ('0x' || substr(h, 2 * i + 1, 2))::bigint as v, m from (select doc_id, h, m, unnest(range(m)) as i from o)),
b as (select doc_id, i - m + 16 as i, v from a where i >= m - 16),
bits as (select doc_id, 15 - i as d, k from b, range(8) r(k) where (v >> k) & 1 = 1),
ends as (select doc_id, bit_xor(e.v) as c from bits join e using (d, k) group by doc_id),
mean as (select doc_id, m, sum(v) // m as mean from a group by doc_id, m),
f as (
  select doc_id, mean, sum((v - mean) * (v - mean)) // m as power, min(v) as low, max(v) as high, sum((turn)::int) as crossings
  from (select *, coalesce((v >= 64) <> (lag(v) over (partition by doc_id order by i) >= 64), false) as turn from a) join mean using (doc_id, m) group by doc_id, m, mean)
select doc_id, n as n_bytes, m as payload_bytes, sha256(unhex(h)) as payload_sha256, xor(xor(coalesce(c, 0), z.v), 4294967295)::bigint as tail_crc32, m + 44 as media_bytes,
  sha256(unhex('52494646' || {_LITTLE.format(n='(m + 36)')} || '57415645666D74201000000001000100401F0000401F00000100080064617461' || {_LITTLE.format(n='m')} || h)) as media_sha256,
  'mean=' || mean::bigint || ';power=' || power::bigint || ';crossings=' || crossings::bigint || ';low=' || low || ';high=' || high as feature
from o left join ends using (doc_id) join f using (doc_id) join e z on z.k = 8 and z.d = 16"""

#: Vectors without null or non-finite components; x holds them in double precision.
_SOUND = "embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0"

NEAR_VECTORS = f"""
with recursive s as (
  select vec_id, len(x) as d, list_transform(x, lambda v: v / sqrt(list_sum(list_transform(x, lambda w: w * w)))) as x
  from (select vec_id, embedding::double[] as x from embeddings where {_SOUND}) where list_sum(list_transform(x, lambda w: w * w)) > 0),
ways as (select a.vec_id as a, b.vec_id as b from s a join s b on a.d = b.d and a.vec_id <> b.vec_id where list_sum(list_transform(range(1, a.d + 1), lambda i: a.x[i] * b.x[i])) >= 0.95),
reach(vec_id, r) as (select vec_id, vec_id from embeddings union select reach.vec_id, ways.b from reach join ways on ways.a = reach.r),
n as (select a as vec_id, count(*) as n from ways group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, min(r) as component_id, vec_id = min(r) as kept from reach left join n using (vec_id) group by vec_id, n"""

HARD_NEGATIVES = f"""
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda v: floor(v::double * 256)::bigint) as x
  from embeddings where label is not null and {_SOUND}),
s as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i]))::bigint as score
  from r a join r b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.x) = len(b.x)),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, vec_id))::int as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 10"""


def _merkle(depth: int = 9) -> str:
    """Trees of up to 8^depth leaves: m(k) has the nodes of level k with their runs, f(k) each leaf's node, siblings and fold."""
    stated = lambda c, x=None: f"coalesce(octet_length(encode(({x or c})::varchar)) || ':' || ({x or c})::varchar, '-')"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda t: "sha256(" + " || ".join([*map(stated, ("doc_id", "source", "lang", "n_chars")), stated("text", t)]) + ")"
    # Level 0 to depth within a language; the languages' roots are level 0 of the upper tree. `alone` nodes rise unchanged.
    level = """
{m}{k} as (
  select {g} up as pos, case when any_value(total) = 1 then any_value(h) else sha256(string_agg(h, '' order by p)) end as h, list(h order by p) as run, any_value(total) as total
  from (select {g} pos as p, pos // 8 as up, h, count(*) over ({over}) as total from {src}) group by {by} up),"""
    ctes = [
        f"""d as (
  select doc_id, coalesce('=' || lang, '') as g, {leaf("text")} as leaf, row_number() over (partition by lang order by doc_id nulls first) - 1 as pos,
    case when crc % 3 = 0 then {leaf(lower)} else {leaf("text")} end as other
  from documents left join c using (doc_id)),""",
        "l0 as (select g, pos, leaf as h from d),",
    ]
    ctes += [level.format(m="l", k=k + 1, g="g,", by="g,", over="partition by g", src=f"l{k}") for k in range(depth)]
    ctes.append(f"u0 as (select row_number() over (order by g) - 1 as pos, g, h from l{depth}),")
    ctes += [level.format(m="u", k=k + 1, g="", by="", over="", src=f"u{k}") for k in range(depth)]
    f, last = [], "(select d.*, '' as proof, other as fold, pos as spot from d)"
    for m, key in (("l", "g, "), ("u", "")):
        if m == "u":
            f.append(f"v as (select x.* replace (u0.pos as spot), u0.h as subroot from {last} x join u0 using (g)),")
            last = "v"
        for k in range(1, depth + 1):
            on = f"x.spot // 8 = n.pos{' and x.g = n.g' if key else ''}"
            f.append(
                f"""{m}f{k} as (
  select x.* replace (case when total = 1 then proof else proof || array_to_string(list_concat(run[1:(spot % 8)], run[(spot % 8) + 2:]), '') end as proof,
    case when total = 1 then fold else sha256(array_to_string(run[1:(spot % 8)], '') || fold || array_to_string(run[(spot % 8) + 2:], '')) end as fold, spot // 8 as spot)
  from {last} x join {m}{k} n on {on}),"""
            )
            last = f"{m}f{k}"
    body = "\n".join(ctes + f).rstrip(",")
    return f"""
with recursive {_CRC.replace("d < 16", "d < 20")}
i as (select distinct doc_id, doc_id::varchar as s from documents where doc_id is not null),
bits as (select doc_id, len(s) - p as d, k from (select doc_id, s, unnest(range(1, len(s) + 1)) as p from i), range(8) r(k) where (ascii(substr(s, p::bigint, 1)) >> k) & 1 = 1),
sums as (select doc_id, bit_xor(v) as v from bits join e using (d, k) group by doc_id),
c as (select i.doc_id, xor(xor(sums.v, z.v), 4294967295) as crc from i join sums using (doc_id) join e z on z.k = 8 and z.d = len(s)),
{body}
select doc_id, leaf, subroot, r.h as root, sha256(proof) as proof_sha256, fold as folded_root, fold = r.h as verified from {last}, u{depth} r"""


#: The checksum goes byte by byte; rows alike in doc_id, checksum and size are interchangeable.
SHARDS = """
with recursive tab(n, k, c) as (select n::bigint, 0, n::bigint from range(256) r(n) union all select n, k + 1, xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end) from tab where k < 8),
step as (select list(c order by n) as s from tab where k = 8),
b as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
p as (select r, i, ('0x' || substr(h, 2 * i + 1, 2))::bigint as v from (select r, h, unnest(range(len(h) // 2)) as i from b)),
l as (select r, list(v order by i) as vs from p group by r),
c as (select r, xor(list_reduce(list_prepend(4294967295::bigint, vs), lambda a, x: xor(s[(xor(a, x) & 255) + 1], a >> 8)), 4294967295::bigint) as crc from l, step),
d as (select doc_id, coalesce(crc, 0)::bigint as text_crc32, (len(h) // 2 + 1)::bigint as size from b left join c using (r)),
o as (
  select *, sum(size) over w - size as before, sum(size) over () as total, row_number() over w - 1 as place from d
  window w as (order by doc_id nulls first, text_crc32, size rows between unbounded preceding and current row)),
x as (select *, least(15, ((before * 2 + size)::hugeint * 16) // (total * 2))::int as shard from o)
select doc_id, size, text_crc32, 'bytes' as law, shard, (place - min(place) over (partition by shard))::bigint as slot, null::int as grown_shard from x"""

ORACLES = {
    "op1_media_chunks": MEDIA,
    "op2_site_lines": linededup.ORACLE,
    "op3_near_duplicates": NEAR,
    "op4_mix_sources": MIX,
    "op5_decontaminate": DECONTAMINATE,
    "op6_suffix_dedup": SUFFIX,
    "op7_byte_shards": SHARDS,
    "op8_substring_dedup": SUBSTRING,
    "op11_near_vectors": NEAR_VECTORS,
    "op12_hard_negatives": HARD_NEGATIVES,
    "op13_merkle_manifest": _merkle(),
}
