"""Independent SQL for the catalogue, in DuckDB's dialect, over the same tables."""

from __future__ import annotations

from sketchloom.functions.numbers import expected_threshold
from sketchloom.functions.seq import DNA_FROM, DNA_TO, LOWER, UPPER
from sketchloom.operators.sketch import DEFAULT_PRIME
from sketchloom.operators.taxonomy import RANKS
from sketchloom.plans import catalog as c
from sketchloom.plans.tables import K, KS, N, N_FOCAL

STEP = 200


def up(col: str) -> str:
    return f"translate({col}, '{LOWER}', '{UPPER}')"


def dna(col: str) -> str:
    return f"translate({up(col)}, '{DNA_FROM}', '{DNA_TO}')"


def rc(col: str) -> str:
    return f"reverse(translate({col}, 'ACGT', 'TGCA'))"


def raw_hash(col: str) -> str:
    return f"cast(('0x' || substr(md5({col}), 1, 15)) as bigint)"


DOCS = f"select cast(doc_id as varchar) as name, {up('text')} as seq from documents"
DOCS_DNA = f"select cast(doc_id as varchar) as name, {dna('text')} as seq from documents"
SAMPLE = f"select 'benchmark' as name, {up('text')} as seq from benchmark"
SAMPLE_DNA = f"select 'benchmark' as name, {dna('text')} as seq from benchmark"
CONVERSATIONS_RAW = "select 'conv-' || conv_id as name, text as seq from conversations"
PAGES = f"select 'page-' || page_id as name, {up('html')} as seq from pages"


def grams(tag: str, source: str, k: int = K, acgt: bool = False) -> str:
    """CTEs ending in ``<tag>_g(name, kmer)``: one row per occurrence, cut by pieces to stay linear."""
    keep = "where not regexp_matches(kmer, '[^ACGT]')" if acgt else ""
    return f"""
{tag}_p as (select name, substring(seq, j * {STEP} + 1, {STEP + k - 1}) as p
  from ({source}) s, unnest(range(0, (length(seq) + {STEP - 1}) // {STEP})) u(j)),
{tag}_a as (select name, substring(p, i, {k}) as kmer
  from {tag}_p, unnest(range(1, least(length(p) - {k} + 2, {STEP + 1}))) v(i)),
{tag}_g as (select name, kmer from {tag}_a {keep})"""


def sketch(tag: str, n: int, k: int = K) -> str:
    """CTE ``<tag>_e(name, slot, h, cnt, kmer)`` from ``<tag>_g``."""
    return f"""
{tag}_c as (select name, kmer, count(*) as c from {tag}_g group by all),
{tag}_h as (select name, {raw_hash('kmer')} % {DEFAULT_PRIME} as h, cast(sum(c) as bigint) as cnt, min(kmer) as kmer
  from {tag}_c group by all),
{tag}_e as (select name, row_number() over (partition by name order by h) - 1 as slot, h, cnt, kmer from {tag}_h
  qualify row_number() over (partition by name order by h) <= {n})"""


def docs(n: int = N) -> str:
    return grams("d", DOCS) + "," + sketch("d", n)


def docs_dna() -> str:
    return grams("d", DOCS_DNA, acgt=True) + "," + sketch("d", N)


def focal() -> str:
    return grams("f", SAMPLE) + "," + sketch("f", N_FOCAL) + "," + docs(N_FOCAL)


PER_SET = "select name, count(*) as kmers, min(kmer) as first_kmer, max(kmer) as last_kmer from {} group by name"
ROWS = "select name, slot, h, cnt, kmer from {}_e"

# -- databases -----------------------------------------------------------------------------------

META = f"""
d_t as (select name, count(distinct kmer) as t from d_g group by name),
d_m as (select s.name, coalesce(t, 0) as true_num_kmers from ({DOCS}) s left join d_t on s.name = d_t.name)"""

FILLED = """
{0}_f as (select name, count(*) as filled, cast(sum(cnt) as bigint) as mass, min(h) as least, max(h) as greatest
  from {0}_e group by name)"""


def summary(tag: str, names: str = "true") -> str:
    return f"""select m.name, m.name as path, cast({K} as bigint) as ksize, cast({DEFAULT_PRIME} as bigint) as prime,
  cast({N} as bigint) as n, true_num_kmers, filled, mass, least, greatest
  from {tag}_m m left join {tag}_f f on m.name = f.name where {names}"""


def database(tail: str) -> str:
    return f"with {docs()}, {META}, {FILLED.format('d')} {tail}"


def extra(tag: str, source: str) -> str:
    """A second database ``<tag>_m``/``<tag>_f`` next to that of the documents."""
    return f"""{grams(tag, source)}, {sketch(tag, N)}, {FILLED.format(tag)},
{tag}_t as (select name, count(distinct kmer) as t from {tag}_g group by name),
{tag}_m as (select distinct s.name, coalesce(t, 0) as true_num_kmers
  from ({source}) s left join {tag}_t on s.name = {tag}_t.name)"""


KMV = f"""
d_k as (select name, case when count(*) >= {N} then cast(round({float(N - 1) * float(DEFAULT_PRIME)!r} / (max(h) + 1)) as bigint) else count(*) end as estimate,
  count(*) >= {N} as "full", count(*) as filled, cast(sum(cnt) as bigint) as mass from d_e group by name)"""

# -- similarity ----------------------------------------------------------------------------------


def walk(pairs: str, limit: int) -> str:
    """CTE ``walk(a, b, ca, cb, counted, rank)`` for ``pairs``: ``(a, b, h, ca, cb)`` over the union."""
    return f"""
w0 as (select a, b, h, ca, cb, row_number() over (partition by a, b order by h) as rank,
    case when ca is null then 2 when cb is null then 1 else 3 end as tag from ({pairs}) q),
w1 as (select *, lag(tag, 1, 3) over (partition by a, b order by h) as before from w0),
w2 as (select *, last_value(case when before = 3 or (before = 2 and tag = 1) then rank end ignore nulls)
    over (partition by a, b order by h rows between unbounded preceding and current row) as begun from w1),
walk as (select a, b, ca, cb, rank, (tag = 3 and begun - 1 <= {limit}) as counted from w2)"""


def focal_walk(focal_first: bool = True) -> str:
    first, second = ("f", "d") if focal_first else ("d", "f")
    side = f"""select {'p.name' if first == 'd' else "''"} as a, {'p.name' if second == 'd' else "''"} as b, h,
      max({first}c) as ca, max({second}c) as cb from (
      select p.name, f_e.h, f_e.cnt as fc, null as dc from (select distinct name from d_e) p, f_e
      union all select name, h, null, cnt from d_e) p group by p.name, h"""
    return focal() + "," + walk(side, N_FOCAL)


def focal_table(select: str, focal_first: bool = True, every: bool = False) -> str:
    key, fc, dc = ("b", "ca", "cb") if focal_first else ("a", "cb", "ca")
    return f"""with {focal_walk(focal_first)},
sums as (select {key} as name, count(*) filter (counted) as common,
  coalesce(cast(sum({fc}) filter (counted) as bigint), 0) as focal_shared,
  coalesce(cast(sum({dc}) filter (counted) as bigint), 0) as other_shared,
  count({fc}) as focal_size, count({dc}) as other_size,
  cast(sum({fc}) as bigint) as focal_total, cast(sum({dc}) as bigint) as other_total,
  count(*) filter ({fc} is not null and {dc} is not null and rank <= {N_FOCAL}) as within,
  count(*) filter ({fc} is not null and {dc} is not null) as shared, count(*) as united
  from walk group by 1),
none as (select cast(doc_id as varchar) as name, 0 as common, 0 as focal_shared, 0 as other_shared,
  (select count(*) from f_e) as focal_size, 0 as other_size, cast((select sum(cnt) from f_e) as bigint) as focal_total, 0 as other_total,
  0 as within, 0 as shared, (select count(*) from f_e) as united
  from documents where {every} and cast(doc_id as varchar) not in (select name from sums))
select name, {select} from (select * from sums union all by name select * from none)"""


REPS = """
sig as (select name, list(struct_pack(h := h, cnt := cnt) order by h) as content from d_e group by name),
cp as (select name, min(name) over (partition by content) as representative from sig),
re as (select d_e.* from d_e join cp on d_e.name = cp.name where cp.name = cp.representative)"""

PAIR_UNION = """select a, b, h, max(ca) as ca, max(cb) as cb from (
  select p.a, p.b, e.h, e.cnt as ca, null as cb from pr p join re e on e.name = p.a
  union all select p.a, p.b, e.h, null, e.cnt from pr p join re e on e.name = p.b) group by all"""


def pairs() -> str:
    """CTE ``cell(i, j, ...)`` with both walking directions for every pair of distinct sketches."""
    return f"""{docs()}, {REPS},
pr as (select distinct x.name as a, y.name as b from re x join re y on x.h = y.h), {walk(PAIR_UNION, N)},
agg as (select a, b, count(*) filter (counted) as common, sum(ca) filter (counted) as ma, sum(cb) filter (counted) as mb,
  count(ca) as size_a, sum(ca) as total_a, sum(cb) as total_b from walk group by a, b),
cell as (select x.a as i, x.b as j, x.common as common_ij, y.common as common_ji, x.size_a as size_i, y.size_a as size_j,
  y.ma as mass_j, y.mb as mass_i, y.total_a as total_j, y.total_b as total_i
  from agg x join agg y on x.a = y.b and x.b = y.a where x.a <= x.b)"""


def clusters(link: float = c.LINK) -> str:
    return f"""
lk as (select i, j from cell where i < j and (common_ij / size_i >= {link} or common_ji / size_j >= {link})),
both_ways as (select i, j from lk union select j, i from lk),
reach(name, seen) as (select name, name from re group by name
  union select reach.name, both_ways.j from reach join both_ways on both_ways.i = reach.seen),
label as (select name, min(seen) as cluster from reach group by name),
cl as (select cp.name, label.cluster from cp join label on cp.representative = label.name
  union all select cast(doc_id as varchar), cast(doc_id as varchar) from documents where cast(doc_id as varchar) not in (select name from cp))"""


CLUSTERS = clusters()

LINEAGE = """
lin as (select cast(doc_id as varchar) as name, 'k__' || lang || '_' || upper(lang) as l1,
  'g__' || lang || '-' || source || '_' || source as l2, 's__d' || doc_id || '_doc_' || doc_id as l3,
  lang, source, doc_id from documents)"""

LCA = f"""
lca as (select cluster, count(*) as size, case when count(*) = 1 then min(l3) when min(l2) = max(l2) then min(l2)
  when min(l1) = max(l1) then min(l1) else 'sk__-1_microorganism' end as lca
  from cl join lin on cl.name = lin.name group by cluster)"""

# -- membership ----------------------------------------------------------------------------------


def member(source: str, sample: str, neutral: bool = False, training: bool = False) -> str:
    acgt = neutral
    key = f"least(kmer, {rc('kmer')})" if neutral else "kmer"
    only = f"where key in (select {key} from d_g)" if training else ""
    return f"""{grams('d', source, acgt=acgt)}, {sketch('d', N)}, {grams('q', sample, acgt=acgt)},
qs as (select key from (select distinct {key} as key from q_g) {only}),
d_t as (select name, count(distinct kmer) as t from d_g group by name),
per as (select d_e.name, count(*) as filled, count(qs.key) as found
  from (select name, {key} as key from d_e) d_e left join qs on d_e.key = qs.key group by d_e.name),
mem as (select per.name, found as intersection, found / filled as ratio, t * (found / filled) as inset, t,
  (select count(*) from qs) as s from per join d_t on per.name = d_t.name),
out as (select name, intersection, round(least(greatest(ratio, 0.0), 1.0), 9) as containment_index,
  round(least(greatest(inset / (t + s - inset), 0.0), 1.0), 9) as jaccard_index from mem)"""


# -- several lengths -----------------------------------------------------------------------------

KLIST = ", ".join(map(str, KS))


def multi() -> str:
    samples = ",".join(grams(f"q{k}", SAMPLE_DNA, k) for k in KS)
    queries = " union ".join(f"select {k} as k, kmer as q from q{k}_g" for k in KS)
    return f"""{docs_dna()},
ix as (select k, substring(t, 1, k) as key, name, slot, substring(kmer, 1, k) as prefix, flipped from (
  select name, slot, kmer, kmer as t, false as flipped from d_e
  union all select name, slot, kmer, {rc('kmer')}, true from d_e), unnest([{KLIST}]) u(k)),
ks as (select distinct k, key from ix),
pf as (select k, key as prefix from ks union select k, {rc('key')} from ks), {samples},
qs as ({queries}),
gated as (select k, q from qs where substring(q, 1, {KS[0]}) in (select prefix from pf where k = {KS[0]})),
ahead as (select k, q as target from gated semi join ks on ks.k = gated.k and ks.key = gated.q),
flip as (select g.k, {rc('g.q')} as target from gated g anti join ks on ks.k = g.k and ks.key = g.q),
target as (select k, target from ahead union select k, target from flip),
mt as (select distinct ix.name, ix.k, ix.slot, ix.prefix from ix join target t on t.k = ix.k and t.target = ix.key),
ht as (select distinct name, k, prefix from mt),
dn as (select s.name, s.k, count(distinct substring(kmer, 1, s.k)) as denom
  from (select cast(doc_id as varchar) as name, k from documents, unnest([{KLIST}]) u(k)) s left join d_e on d_e.name = s.name group by all),
ct as (select dn.name, dn.k, coalesce(hits, 0) as hits, denom,
  case when denom > 0 then coalesce(hits, 0) / denom else 0.0::double end as ci from dn
  left join (select name, k, count(*) as hits from ht group by all) h on h.name = dn.name and h.k = dn.k),
wd as (select name, {', '.join(f'max(ci) filter (k = {k}) as k_{k}' for k in KS)} from ct group by name)"""


WIDE = f"select name, {', '.join(f'round(k_{k}, 9) as k_{k}' for k in KS)} from wd"
CT = "select name, cast(k as bigint) as k, hits, denom, round(ci, 9) as ci from {}"

SPECIFIC = f"""
ch as (select name from wd where k_{KS[-1]} >= {c.LEAST}),
se as (select d_e.* from d_e semi join ch on ch.name = d_e.name),
sp as (select name, k, substring(kmer, 1, k) as prefix from se, unnest([{KLIST}]) u(k)),
un as (select min(name) as name, k, prefix from sp group by k, prefix having count(*) = 1),
post as (select s.name, s.k, coalesce(h.hits, 0) as hits, s.denom + case when f.filled < {N} then 1 else 0 end as denom
  from (select name, k, count(distinct prefix) as denom from sp group by all) s
  join (select name, count(*) as filled from se group by name) f on f.name = s.name
  left join (select ht.name, ht.k, count(*) as hits from ht join un on un.name = ht.name and un.k = ht.k
    and un.prefix = ht.prefix group by all) h on h.name = s.name and h.k = s.k)"""


def exact() -> str:
    """CTEs ``tr(name, k, kmer)`` and ``qr(k, kmer)``: all distinct canonical shingles; ``gt`` compares them."""
    ctes = ",".join(grams(f"d{k}", DOCS_DNA, k, True) + "," + grams(f"s{k}", SAMPLE_DNA, k, True) for k in KS)
    train = " union all ".join(f"select distinct name, {k} as k, least(kmer, {rc('kmer')}) as kmer from d{k}_g" for k in KS)
    query = " union all ".join(f"select distinct {k} as k, least(kmer, {rc('kmer')}) as kmer from s{k}_g" for k in KS)
    return f"""{ctes}, tr as ({train}), qr as ({query}),
gt as (select tr.name, tr.k, count(qr.kmer) as hits, count(*) as denom, count(qr.kmer) / count(*) as ci
  from tr left join qr on qr.k = tr.k and qr.kmer = tr.kmer group by all)"""


def shingle_statistics() -> str:
    ctes = ",".join(grams(f"d{k}", DOCS_DNA, k, True) for k in KS)
    counted = " union all ".join(f"select name, {k} as k, least(kmer, {rc('kmer')}) as kmer, count(*) as c from d{k}_g group by all" for k in KS)
    return f"""with {ctes}, every as ({counted}) select name, cast(k as bigint) as k, cast(sum(c) as bigint) as total,
        count(*) as distinct, count(*) filter (c = 1) as single from every group by name, k"""


# -- profiles ------------------------------------------------------------------------------------


def trade(tag: str, who: str) -> str:
    """CTE ``<tag>(tax_id, rank, path, sn, ancestor, branch_length, depth, abundance, up)``."""
    s = who[0]
    key = {"customer": "c_custkey", "supplier": "s_suppkey"}[who]
    return f"""
{tag}0 as (select 'r' || n_regionkey as r, 'n' || n_nationkey as n, 'z' || n_nationkey % 3 as z,
    'h' || n_nationkey || '-' || {key} % 2 as h from {who} join nation on {s}_nationkey = n_nationkey),
{tag}1 as (select r as tax_id, 'region' as rank, r as path, upper(r) as sn, '-1' as ancestor, 1 as branch_length,
    1 as depth, 4.0 * count(*) as abundance, [r] as up from {tag}0 group by r
  union all select n, 'nation', r || '||' || n, upper(r || '|' || z || '|' || n), r, 2, 3, 2.0 * count(*), [r, n]
    from {tag}0 group by r, z, n
  union all select h, 'half', r || '||' || n || '|' || h, upper(r || '|' || z || '|' || n || '|' || h), n, 1, 4,
    1.0 * count(*), [r, n, h] from {tag}0 group by r, z, n, h),
{tag} as (select * replace (cast(abundance as double) as abundance) from {tag}1),
{tag}_own as (select p.* replace (p.abundance - coalesce(b.below, 0) as abundance) from {tag} p
  left join (select ancestor, sum(abundance) as below from {tag} group by ancestor) b on b.ancestor = p.tax_id)"""


def added(tag: str, rows: str) -> str:
    return f"""
{tag}_sum as (select u as tax_id, sum(abundance) as total from (select unnest(up) as u, abundance from {rows}) group by u),
{tag}_add as (select p.* replace (s.total as abundance) from {rows} p join {tag}_sum s on s.tax_id = p.tax_id)"""


NORMAL = """
{0}_pct as (select * replace (abundance / (select sum(abundance) from {0}_own) * 100 as abundance) from {0}_own)"""

PROFILE = """select tax_id, rank, path as tax_path, sn as tax_path_sn, ancestor,
  cast(branch_length as bigint) as branch_length, round(abundance, 9) as abundance from """

TAXA = """
taxa as (select name, 'k' as rank, upper(lang) as label, lang as tax_id, lang as path, upper(lang) as sn from lin
  union all select name, 'g', source, lang || '-' || source, lang || '|' || lang || '-' || source,
    upper(lang) || '|' || source from lin
  union all select name, 's', 'doc ' || doc_id, 'd' || doc_id, lang || '|' || lang || '-' || source || '|d' || doc_id,
    upper(lang) || '|' || source || '|doc ' || doc_id from lin)"""

RANK_CASE = "case rank " + " ".join(f"when '{k}' then '{v}'" for k, v in RANKS.items()) + " end"


def oracle() -> dict[str, str]:
    sql = {
        "kmer_extract": f"with {grams('d', DOCS)} {PER_SET.format('d_g')}",
        "kmer_distinct_count": f"with {grams('d', DOCS)} select name, count(distinct kmer) as true_num_kmers from d_g group by name",
        "hll_cardinality": f"with {grams('d', DOCS)} select name, count(distinct kmer) as exact, true as within from d_g group by name",
        "revcomp": f"select name, md5({rc('seq')}) as digest from ({DOCS_DNA}) s",
        "dna_image": f"select page_id, md5({dna('html')}) as digest from pages",
        "canonical_kmers": f"""with {grams('d', DOCS_DNA, acgt=True)},
            cn as (select distinct name, least(kmer, {rc('kmer')}) as kmer from d_g) {PER_SET.format('cn')}""",
        "acgt_split_kmers": f"with {grams('d', DOCS_DNA, acgt=True)} {PER_SET.format('d_g')}",
        "bottom_n_sketch": f"with {docs()} {ROWS.format('d')}",
        "down_sample": f"with {docs(50)} {ROWS.format('d')}",
        "hash_list_sketch": f"""with {grams('f', SAMPLE)}, {sketch('f', N_FOCAL)}, {grams('x', DOCS)},
            d_g as (select * from x_g where {raw_hash('kmer')} % {DEFAULT_PRIME} in (select h from f_e)),
            {sketch('d', N)} {ROWS.format('d')}""",
        "minhash_strand_sketch": f"""with {grams('x', DOCS_DNA, acgt=True)},
            x2 as (select name, kmer, {rc('kmer')} as flipped, {raw_hash('kmer')} as h1, {raw_hash(rc('kmer'))} as h2 from x_g),
            x3 as (select name, least(h1, h2) % {DEFAULT_PRIME} as h, case when h2 <= h1 then flipped else kmer end as kmer from x2),
            d_h as (select name, h, count(*) as cnt, min(kmer) as kmer from x3 group by name, h)
            select name, row_number() over (partition by name order by h) - 1 as slot, h, cnt, kmer from d_h
            qualify row_number() over (partition by name order by h) <= {N}""",
        "merged_sketch": f"""with {grams('d', DOCS)}, {sketch('d', N)},
            m as (select source as name, h, cast(sum(cnt) as bigint) as cnt, min(kmer) as kmer
              from d_e join documents on cast(doc_id as varchar) = d_e.name group by all)
            select name, row_number() over (partition by name order by h) - 1 as slot, h, cnt, kmer from m
            qualify row_number() over (partition by name order by h) <= {N}""",
        "sketch_info": f"""select count(*) as sketches, min(cast(doc_id as varchar)) as first_name, cast({K} as bigint) as ksize,
            cast({DEFAULT_PRIME} as bigint) as prime, cast({N} as bigint) as sketch_size from documents""",
        "db_build": database(summary("d")),
        "db_import_subset": database(summary("d", "m.name in (select cast(doc_id as varchar) from labels)")),
        "db_delete": database(summary("d", "m.name not in (select cast(doc_id as varchar) from labels where toxic = 1)")),
        "db_insert": f"with {docs()}, {META}, {FILLED.format('d')}, {extra('x', CONVERSATIONS_RAW)} "
        + summary("d") + " union all " + summary("x"),
        "db_union": f"with {docs()}, {META}, {FILLED.format('d')}, {extra('x', PAGES)} "
        + summary("d") + " union all " + summary("x"),
        "common": focal_table("common", every=True),
        "common_count": focal_table("focal_shared, other_shared", every=True),
        "jaccard": focal_table("coalesce(round(common / nullif(other_size, 0), 9), 0) as jaccard", focal_first=False, every=True),
        "jaccard_vector": focal_table("round(common / focal_size, 9) as jaccard", every=True),
        "jaccard_dist": focal_table("round(1 - common / focal_size, 9) as distance", every=True),
        "jaccard_count": focal_table(
            "coalesce(round(other_shared / nullif(other_total, 0), 9), 0) as share_of_other, round(focal_shared / focal_total, 9) as share_of_focal",
            every=True,
        ),
        "count_vector": focal_table("round(focal_shared / focal_total, 9) as share", every=True),
        "mash_jaccard": focal_table(f"round(within / least({N_FOCAL}, united), 9) as jaccard", every=True),
        "capped_overlap": focal_table(
            "common, focal_shared, other_shared, focal_size, other_size, focal_total, other_total", every=True
        ),
        "sketch_containment": focal_table("coalesce(round(shared / nullif(other_size, 0), 9), 0) as containment", every=True),
        "kmv_cardinality": f"""with {docs()}, {META}, {KMV} select name, true_num_kmers as exact, estimate,
            abs(estimate - true_num_kmers) <= case when "full" then 5 * (1.0::double / sqrt({N - 2})) else 0 end * true_num_kmers + 1 as within
            from d_k join d_m using (name)""",
        "built_once": f"""with {docs()}, {META}, {KMV} select name, coalesce(estimate, 0) as estimate, filled, mass from d_m left join d_k using (name)""",
        "sketch_copies": f"with {docs()}, {REPS} select name, representative from cp",
        "jaccard_matrix": f"""with {pairs()} select i as name_i, j as name_j, round(common_ij / size_i, 9) as jaccard_ij,
            round(common_ji / size_j, 9) as jaccard_ji from cell where common_ij > 0 or common_ji > 0""",
        "jaccard_count_matrix": f"""with {pairs()} select i as name_i, j as name_j, round(mass_j / total_j, 9) as cell_ij,
            round(mass_i / total_i, 9) as cell_ji from cell where common_ji > 0""",
        "similar_pairs": f"""with {pairs()} select i as name_i, j as name_j, round(common_ij / size_i, 9) as jaccard_ij,
            round(common_ji / size_j, 9) as jaccard_ji from cell where common_ij / size_i >= {c.LINK} or common_ji / size_j >= {c.LINK}""",
        "similar_count_pairs": f"""with {pairs()} select i as name_i, j as name_j, round(mass_j / total_j, 9) as cell_ij,
            round(mass_i / total_i, 9) as cell_ji from cell where common_ji > 0 and (common_ij / size_i >= {c.NEAR} or common_ji / size_j >= {c.NEAR})""",
        "joined_clusters": f"with recursive {pairs()}, {clusters(c.NEAR)} select name, cluster from cl",
        "linkage_cut": f"with recursive {pairs()}, {clusters(c.NEAR)} select name, cluster from cl",
        "cluster_components": f"with recursive {pairs()}, {CLUSTERS} select name, cluster from cl",
        "cluster_lca": f"with recursive {pairs()}, {CLUSTERS}, {LINEAGE}, {LCA} select cluster, size, lca from lca",
        "cluster_fasta_records": f"""with recursive {pairs()}, {CLUSTERS}, {LINEAGE}, {LCA}
            select cl.cluster, lca, cl.name, md5(text) as digest from cl join lca on lca.cluster = cl.cluster
            join documents on cast(doc_id as varchar) = cl.name""",
        "kmer_lookup": f"""with {docs()}, {grams('q', SAMPLE)}
            select kmer, name from d_e where kmer in (select kmer from q_g)""",
        "kmer_fasta_dump": f"with {docs()} select distinct kmer from d_e",
        "membership_containment": f"with {member(DOCS, SAMPLE)} select * from out",
        "membership_intersect_only": f"with {member(DOCS, SAMPLE, training=True)} select * from out",
        "membership_strand_neutral": f"with {member(DOCS_DNA, SAMPLE_DNA, neutral=True)} select * from out",
        "threshold_calc": f"""with {member(DOCS, SAMPLE)} select * from out
            where containment_index > {expected_threshold(N, 0.2, 0.0001, 0.95)!r}""",
        "prefix_index": f"""with {multi()} select cast(k as bigint) as k, name, count(*) as entries, count(distinct key) as keys,
            min(key) as first_key, max(key) as last_key, count(*) filter (flipped) as flipped from ix group by all""",
        "prefilter": f"with {multi()} select cast(k as bigint) as k, substring(prefix, 1, 4) as start, count(*) as keys, "
        "min(prefix) as first_key, max(prefix) as last_key from pf group by all",
        "multi_k_matches": f"with {multi()} select name, cast(k as bigint) as k, slot, prefix from mt",
        "multi_k_indexed": f"with {multi()} select name, cast(k as bigint) as k, slot, prefix from mt",
        "multi_k_hits": f"with {multi()} select name, cast(k as bigint) as k, prefix from ht",
        "multi_k_containment": f"with {multi()} {CT.format('ct')}",
        "stream_containment": f"with {multi()} {CT.format('ct')}",
        "containment_wide": f"with {multi()} {WIDE}",
        "containment_threshold_at_k": f"with {multi()} {WIDE} where wd.k_{KS[1]} >= {c.LEAST} order by wd.k_{KS[-1]} desc, name",
        "unique_kmers": f"with {multi()}, {SPECIFIC} select name, cast(k as bigint) as k, prefix from un",
        "num_unique_kmers": f"""with {multi()}, {SPECIFIC} select s.name, cast(s.k as bigint) as k, count(un.prefix) as num_unique
            from (select distinct name, k from sp) s left join un on un.name = s.name and un.k = s.k group by all""",
        "postprocess_containment": f"""with {multi()}, {SPECIFIC} select name, cast(k as bigint) as k, hits,
            cast(denom as bigint) as denom, round(hits / denom, 9) as ci from post""",
        "ground_truth": f"with {exact()} {CT.format('gt')}",
        "shingle_statistics": shingle_statistics(),
        "ground_truth_intersection": f"""with {exact()} select cast(k as bigint) as k, count(*) as kmers, min(kmer) as first_kmer,
            max(kmer) as last_kmer from (select distinct k, kmer from tr intersect select k, kmer from qr) group by k""",
        "truth_error_stats": f"""with {multi()}, {exact()},
            gap as (select ct.k, round(abs(ct.ci - gt.ci), 12) as gap from ct join gt on gt.name = ct.name and gt.k = ct.k)
            select cast(k as bigint) as k, count(*) as pairs, round(sum(gap), 6) as total, round(avg(gap), 9) as mean,
            round(median(gap), 9) as median from gap group by k""",
        "profile_parse": f"with {trade('p', 'customer')} {PROFILE} p",
        "profile_threshold": f"""with {trade('p', 'customer')}, q as (select * replace (case when abundance < 50 then 0.0
            else abundance end as abundance) from p) {PROFILE} q""",
        "profile_subtract_down": f"with {trade('p', 'customer')} {PROFILE} p_own",
        "profile_add_up": f"with {trade('p', 'customer')}, {added('p', 'p')} {PROFILE} p_add",
        "profile_normalize": f"with {trade('p', 'customer')}, {NORMAL.format('p')}, {added('p', 'p_pct')} {PROFILE} p_add",
        "profile_merge": f"""with {trade('p', 'customer')}, {trade('q', 'supplier')},
            m as (select tax_id, any_value(rank) as rank, any_value(path) as path, any_value(sn) as sn,
              any_value(ancestor) as ancestor, any_value(branch_length) as branch_length, sum(abundance) as abundance
              from (select * from p union all select * from q) group by tax_id) {PROFILE} m""",
        "profile_write_lines": f"""with {trade('p', 'supplier')}, {NORMAL.format('p')}, {added('p', 'p_pct')}
            select cast(depth as bigint) as depth, tax_id,
            concat_ws(chr(9), tax_id, rank, path, sn, printf('%.6f', abundance)) as line from p_add where abundance > 1e-16""",
        "unifrac_input": f"""with {trade('p', 'customer')}, {trade('q', 'supplier')},
            nd as (select tax_id, any_value(ancestor) as ancestor, any_value(branch_length) as bl, any_value(depth) as depth
              from (select * from p union all select * from q) group by tax_id),
            nn as (select tax_id, ancestor, bl, row_number() over (order by depth desc, md5(tax_id), tax_id) - 1 as node from nd
              union all select '-1', null, null, (select count(*) from nd))
            select nn.node, nn.tax_id, up.node as ancestor_node, cast(nn.bl as bigint) as branch_length,
            round(coalesce(p_own.abundance, 0) / (select sum(abundance) from p_own), 9) as p,
            round(coalesce(q_own.abundance, 0) / (select sum(abundance) from q_own), 9) as q
            from nn left join nn up on up.tax_id = nn.ancestor left join p_own on p_own.tax_id = nn.tax_id
            left join q_own on q_own.tax_id = nn.tax_id""",
        "profile_from_result": f"""with {multi()}, {LINEAGE}, {TAXA}
            select distinct tax_id, {RANK_CASE} as rank, path as tax_path, sn as tax_path_sn, 0.01::double as abundance
            from taxa where name in (select name from wd where k_{K} > {c.LEAST})""",
        "tp_fp_fn": f"""with {multi()}, {LINEAGE}, {TAXA},
            best as (select rank, tax_id, max(k_{K}) as score from taxa join wd on wd.name = taxa.name group by all),
            tru as (select distinct rank, tax_id from taxa
              where name in (select cast(doc_id as varchar) from labels where quality = 1)),
            al as (select coalesce(best.rank, tru.rank) as rank, coalesce(score, -1) as score, tru.tax_id is not null as hit
              from best full join tru on tru.rank = best.rank and tru.tax_id = best.tax_id)
            select rank, threshold, count(*) filter (score > threshold and hit) as tp,
            count(*) filter (score > threshold and not hit) as fp, count(*) filter (score <= threshold and hit) as fn
            from al, unnest([{', '.join(f'{x!r}::double' for x in c.THRESHOLDS)}]) u(threshold) group by all""",
        "taxonomy_repath": """select c_name as name, length(c_mktsegment) || '_THE_' || c_mktsegment as organism,
            cast(length(c_mktsegment) as varchar) as tax_id, 'k__' || r_regionkey || '_' || replace(r_name, ' ', '_') || '|p__'
            || n_nationkey || '_' || replace(n_name, ' ', '_') || '|c__' || length(c_mktsegment) || '_THE_' || c_mktsegment as path
            from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
        "results_with_taxonomy": f"""with {multi()}, {LINEAGE} select wd.name, 'doc_' || doc_id as organism, 'd' || doc_id as tax_id,
            l1 || '|' || l2 || '|' || l3 as path, round(k_{K}, 9) as ci from wd join lin on lin.name = wd.name""",
        "concat_reference": f"""select cast(conv_id as varchar) as name, turn as at, cast(-1 as bigint) as part, '{"N" * 69}' as text
            from conversations union all select cast(conv_id as varchar), turn, 0, text from conversations where text <> ''""",
    }
    records = """select cast(doc_id as varchar) as record, length(seq) as letters, md5(seq) as digest
        from (select doc_id, translate(text, chr(10) || chr(13) || '>@+', '') as seq from documents)"""
    sql |= dict.fromkeys(("fasta_scan", "fasta_range_scan", "fastq_scan", "gz_scan"), records)
    sql |= {
        "db_round_trip": sql["db_import_subset"],
        "index_round_trip": sql["prefix_index"],
        "match_tsv_round_trip": sql["multi_k_matches"],
        "hit_matrix_round_trip": f"select distinct name, k, slot from ({sql['multi_k_matches']})",
        "db_append_and_mark": f"with {docs()}, {META}, {FILLED.format('d')}, {extra('x', CONVERSATIONS_RAW)} "
        + summary("d", "m.name not in (select cast(doc_id as varchar) from labels where toxic = 1)") + " union all " + summary("x"),
        "result_csv_round_trip": sql["containment_wide"],
        "kmer_fasta_round_trip": f"with {docs_dna()} select distinct kmer from d_e",
        "cluster_fasta_round_trip": f"""with recursive {pairs()}, {CLUSTERS}, {LINEAGE}, {LCA}
            select lca, count(*) as records, count(*) - 1 as last, count(*) as numbers,
            min(md5(translate(text, chr(10) || chr(13) || '>@+', ''))) as least
            from cl join lca on lca.cluster = cl.cluster join documents on cast(doc_id as varchar) = cl.name group by cl.cluster, lca""",
        "profile_text_parse": f"""with {trade('p', 'supplier')}, {NORMAL.format('p')}, {added('p', 'p_pct')},
            q as (select * replace (round(abundance, 6) as abundance) from p_add where abundance > 1e-16) {PROFILE} q""",
        "taxonomy_text_parse": f"""with {LINEAGE}
            select name, 'doc_' || doc_id as organism, 'd' || doc_id as tax_id, l1 || '|' || l2 || '|' || l3 as path from lin""",
        "truth_text_parse": """with g as (select * from documents where doc_id in (select doc_id from labels where quality = 1))
            select 'k' as rank, lang as tax_id from g union select 'g', source from g""",
        "sample_set_round_trip": f"with {grams('q', SAMPLE_DNA, acgt=True)} select distinct least(kmer, {rc('kmer')}) as kmer from q_g",
    }
    return sql
