"""DuckDB equivalents of the catalogued queries over the same Parquet tables.

Every statement starts from the derived tables below.  Doubles are rounded to the
digits of the Spark query; ``+ 0.0`` turns a negative zero into zero.
"""

from __future__ import annotations

BASE = """
with recursive sizes as (
  select greatest(1, (parts + vectors - 1) // vectors) as width,
         (parts - 1) // greatest(1, (parts + vectors - 1) // vectors) + 1 as n,
         vectors, orders
  from (select (select max(p_partkey) + 1 from part) as parts,
               (select max(vec_id) + 1 from embeddings) as vectors,
               (select max(l_orderkey) + 1 from lineitem) as orders)
),
chroms as (
  select 0 as chrom_idx, 'chr1' as chrom, 0 as lo, cast(n * 4 // 10 as int) as hi from sizes
  union all select 1, 'chr2', cast(n * 4 // 10 as int), cast(n * 7 // 10 as int) from sizes
  union all select 2, 'chrX', cast(n * 7 // 10 as int), cast(n * 9 // 10 as int) from sizes
  union all select 3, 'chrY', cast(n * 9 // 10 as int), cast(n as int) from sizes
),
bins as (
  select b.bin_id, c.chrom_idx, c.chrom, c.lo, c.hi, b.weight
  from (select cast(p_partkey // width as int) as bin_id,
               case when (avg(p_size) - 25.5) * sqrt(count(*)) >= -23.0
                    then 1000.0::double / avg(p_retailprice) end as weight
        from part, sizes group by 1) b
  join chroms c on b.bin_id >= c.lo and b.bin_id < c.hi
),
good as (select * from bins where weight is not null),
contacts as (
  select cast(least(l_partkey // width, l_orderkey * n // orders) as int) as bin1_id,
         cast(greatest(l_partkey // width, l_orderkey * n // orders) as int) as bin2_id,
         cast(l_partkey // width as int) as row_id, cast(l_orderkey * n // orders as int) as col_id,
         l_linenumber as replicate, l_suppkey as cell_id
  from lineitem, sizes
),
pixels as (select bin1_id, bin2_id, count(*) as count from contacts group by 1, 2),
reps as (select bin1_id, bin2_id, replicate, count(*) as count from contacts group by 1, 2, 3),
halves as (select bin1_id, bin2_id, case when replicate % 2 = 1 then 1 else 2 end as replicate,
                  cast(sum(count) as bigint) as count from reps group by 1, 2, 3),
ends as (
  select p.*, a.weight as w1, b.weight as w2, a.chrom_idx as c1, b.chrom_idx as c2
  from pixels p join bins a on a.bin_id = p.bin1_id join bins b on b.bin_id = p.bin2_id
),
balanced as (select bin1_id, bin2_id, c1, c2, count, count * w1 * w2 as value from ends),
cells as (select * from balanced where value is not null),
raw_states as (
  select cast(vec_id * n // vectors as int) as bin_id,
         greatest(0.01, least(0.99, avg(abs(list_sum(list_transform(range(1, len(embedding) + 1, 3), lambda i: embedding[i]::double)))))) as e0,
         greatest(0.01, least(0.99, avg(abs(list_sum(list_transform(range(2, len(embedding) + 1, 3), lambda i: embedding[i]::double)))))) as e1,
         greatest(0.01, least(0.99, avg(abs(list_sum(list_transform(range(3, len(embedding) + 1, 3), lambda i: embedding[i]::double)))))) as e2
  from embeddings, sizes group by 1
),
all_states as (select bin_id, e0 / (e0 + e1 + e2) as p0, e1 / (e0 + e1 + e2) as p1, e2 / (e0 + e1 + e2) as p2
               from raw_states),
states as (select s.*, b.chrom_idx as c, b.weight as w from all_states s join good b using (bin_id)),
pairs as (
  select a.bin_id as bin1_id, b.bin_id as bin2_id, a.c = b.c as cis,
         ln((b.bin_id - a.bin_id)::double) as ln_d, a.c as c1, b.c as c2,
         a.p0 as a0, a.p1 as a1, a.p2 as a2, b.p0 as b0, b.p1 as b1, b.p2 as b2
  from states a join states b on a.bin_id < b.bin_id
),
terms as (
  select *, case when cis then -0.8 * ln_d else -2.1 end as ln_decay,
         case when cis then -0.8 * (ln_d + ln(50000.0::double)) else -2.1 end as ln_decay_r,
         case when cis
              then 0.36*a0*b0 + 0.24*a1*b1 + 0.3*a2*b2 + 0.08*(a0*b1 + a1*b0) + 0.02*(a0*b2 + a2*b0) + 0.06*(a1*b2 + a2*b1)
              else 0.12*a0*b0 + 0.28*a1*b1 + 0.33*a2*b2 + 0.04*(a0*b1 + a1*b0) + 0.1*(a0*b2 + a2*b0) + 0.05*(a1*b2 + a2*b1) end as g
  from pairs
),
counted as (select t.*, p.count from terms t join pixels p using (bin1_id, bin2_id))
"""

MIRROR = """select bin1_id, bin2_id, {v} from {t}
  union all select bin2_id, bin1_id, {v} from {t} where bin1_id <> bin2_id"""


def rnd(expr: str, digits: int) -> str:
    return f"round({expr}, {digits}) + 0.0"


# Distance-normalised matrix: diagonal means over all usable pairs, zero cells included.
NORMALISED = """,
diag_pairs as (select b.bin_id - a.bin_id as d, count(*) as n from good a join good b on a.bin_id < b.bin_id group by 1),
diag_sums as (select bin2_id - bin1_id as d, sum(value) as s from cells where bin1_id < bin2_id group by 1),
diag_means as (select d, s / n as m, n from diag_pairs join diag_sums using (d)),
normed as (
  select bin1_id, bin2_id, value, value / m / (select sum(n) from diag_means where m <> 0) as normalised
  from cells join diag_means on bin2_id - bin1_id = d where bin1_id < bin2_id)
"""

def drawn_zeros(name: str, seed: int, n: int, which: str) -> str:
    """CTEs of a sample: numbers of the zeros row by row and the keyed permutation of 0..n-1."""
    square = "('0x' || substr(md5(concat_ws(':', '{seed}', r, {x})), 1, 13))::bigint"
    moved = (f"case when r % 2 = 0 then ((v // cols + {square.format(seed=seed, x='v % cols')}) % rws) * cols + v % cols "
             f"else (v // cols) * cols + (v % cols + {square.format(seed=seed, x='v // cols')}) % cols end")
    shuffled = "list_reduce(list_concat([{v}], range(0, 8)), lambda v, r: " + moved + ")"
    return f"""
{name}_all as (select bin1_id, bin2_id, row_number() over (order by bin1_id, bin2_id) - 1 as number from zeros where {which}),
{name}_size as (
  select z, rws, (z + rws - 1) // rws as cols
  from (select z, cast(floor(sqrt(greatest(z, 1) - 1)) as bigint) + 1 as rws from (select count(*) as z from {name}_all))),
{name}_walk(k, v) as (
  select k, {shuffled.format(v='k')} from (select unnest(range(0, least({n}, z))) as k, rws, cols, z from {name}_size)
  union all select k, {shuffled.format(v='v')} from {name}_walk, {name}_size where v >= z),
{name} as (select bin1_id, bin2_id from {name}_all join {name}_walk on number = v)"""


ZEROS = """,
cand as (select a.bin_id as bin1_id, b.bin_id as bin2_id, a.chrom_idx as c1, b.chrom_idx as c2
         from good a join good b on a.bin_id <= b.bin_id),
zeros as (select c.* from cand c anti join pixels p on c.bin1_id = p.bin1_id and c.bin2_id = p.bin2_id),
""" + drawn_zeros("zsample", 7, 1000, "true") + "," + drawn_zeros("ztrans", 8, 1000, "c1 <> c2") + """,
weighted as (
  select t.*, p.count::double as x, 1.0::double as times from terms t join pixels p using (bin1_id, bin2_id)
  union all
  select t.*, 0.0, (select count(*) from zeros)::double / least(1000, (select count(*) from zeros))
  from terms t join zsample z using (bin1_id, bin2_id)
)
"""

STATE_VALUES = ", ".join(rnd(f"p{k}", 9) + f" as p{k}" for k in range(3))
CIS_W = [[0.36, 0.08, 0.02], [0.08, 0.24, 0.06], [0.02, 0.06, 0.3]]
TRANS_W = [[0.12, 0.04, 0.1], [0.04, 0.28, 0.05], [0.1, 0.05, 0.33]]


def towards(side: str) -> list[str]:
    """Entries of W times the state vector of one end, by pair kind."""
    out = []
    for s in range(3):
        cis = " + ".join(f"{CIS_W[s][t]}*{side}{t}" for t in range(3))
        trans = " + ".join(f"{TRANS_W[s][t]}*{side}{t}" for t in range(3))
        out.append(f"(case when cis then {cis} else {trans} end)")
    return out


def gradient_states(source: str, x: str, mass: str, decay: str) -> str:
    """Gradient by state probabilities: both ends of every pair, then combined with Z."""
    first, second = towards("b"), towards("a")
    halves = []
    for end, w in (("bin1_id", first), ("bin2_id", second)):
        cols = ", ".join(f"{x} / g * {w[k]} as x{k}, {decay} * {w[k]} as m{k}" for k in range(3))
        halves.append(f"select {end} as bin_id, {cols} from {source}")
    grads = ", ".join(rnd(f"sum(x{k}) - (select sum({x}) / sum({mass}) from {source}) * sum(m{k})", 5) + f" as g{k}"
                      for k in range(3))
    return f"select bin_id, {grads} from ({' union all '.join(halves)}) group by bin_id"


def gradient_shared(source: str, x: str, mass: str, decay: str, ln_d: str, symmetric_mass: bool) -> str:
    rows = []
    ratio = f"(select sum({x}) / sum({mass}) from {source})"
    for kind, flag in (("cis", "cis"), ("trans", "not cis")):
        for s in range(3):
            for t in range(3):
                pair = f"a{s}*b{t}"
                m = f"(a{s}*b{t} + a{t}*b{s}) / 2" if symmetric_mass else pair
                rows.append(f"select '{kind}' as param, {s} as s1, {t} as s2, "
                            + rnd(f"sum({x} / g * {pair}) - {ratio} * sum({decay} * {m})", 3)
                            + f" as grad from {source} where {flag}")
    rows.append(f"select 'alpha', 0, 0, " + rnd(f"sum({x} * {ln_d}) - {ratio} * sum({mass} * {ln_d})", 3)
                + f" from {source} where cis")
    rows.append(f"select 'beta', 0, 0, " + rnd(f"sum({x}) - {ratio} * sum({mass})", 3)
                + f" from {source} where not cis")
    return " union all ".join(rows)


ALL_PAIRS = """,
allp as materialized (select t.*, coalesce(p.count, 0)::double as x, exp(ln_decay_r) as dr, g * exp(ln_decay_r) as mr,
                ln_d + ln(50000.0::double) as ln_dr
         from terms t left join pixels p using (bin1_id, bin2_id)),
mass as materialized (select sum(mr) as z, sum(x) as reads from allp),
model as materialized (select bin1_id, bin2_id, x as a, mr / z as b, c1, c2 from allp, mass)
"""

GROUPS = """,
grp as (
  select 's1' as name, bin_id from states where p0 > 0.5
  union all select 's2', bin_id from states where p1 > 0.5 and p0 < 0.4
  union all select 'mixed', bin_id from states where p2 > 0.4 and p0 < 0.5)
"""


def profile_cte(prefix: str, source: str) -> str:
    return f""",
{prefix}_full as ({MIRROR.format(v='value', t=source)}),
{prefix}_sum as (select g.name, c.bin_id as col,
    coalesce(sum(case when abs(f.bin1_id - f.bin2_id) > 4 then f.value end), 0.0) as s
  from (select distinct name from grp) g cross join good c
  left join grp on grp.name = g.name
  left join {prefix}_full f on f.bin1_id = grp.bin_id and f.bin2_id = c.bin_id group by 1, 2),
{prefix}_one as (select name, col, s / sum(s) over (partition by name) + 1e-10 as p from {prefix}_sum),
{prefix}_p as (select name as profile, col, p / sum(p) over (partition by name) as p from {prefix}_one)
"""


VECTORS = """,
cellpix as (select cell_id, bin1_id, bin2_id, count(*) as count from contacts group by 1, 2, 3),
vec as (
  select cell_id, c as col, sum(count) as count from (
    select cell_id, bin1_id as r, bin2_id as c, count from cellpix where bin2_id - bin1_id > 4
    union all select cell_id, bin2_id, bin1_id, count from cellpix where bin2_id - bin1_id > 4)
  where r in (select bin_id from grp where name = 'mixed') and c in (select bin_id from good) group by 1, 2),
coeff as (select cell_id, lgamma(sum(count)::double + 1) - sum(lgamma(count::double + 1)) as k from vec group by 1)
"""


def scores(prefix: str) -> str:
    return f""",
{prefix}_score as (
  select cell_id, profile, sum(count * ln(p)) + any_value(k) as score
  from vec join {prefix}_p using (col) join coeff using (cell_id) group by 1, 2),
{prefix}_lr as (
  select cell_id, max(case when profile = 'mixed' then score end)
                  - max(case when profile in ('s1', 's2') then score end) as lr
  from {prefix}_score group by 1)
"""


def balance_sql(passes: int) -> str:
    """Alternating scaling, unrolled."""
    parts = [f""",
full_x as ({MIRROR.format(v='count', t='pixels')}),
f0 as (select distinct bin1_id as bin_id, 1.0::double as r, 1.0::double as c from full_x)"""]
    for k in range(passes):
        parts.append(f""",
m{k} as (select x.bin2_id as bin_id, sum(x.count * f.r) / (select count(*) from f0) as s
         from full_x x join f{k} f on f.bin_id = x.bin1_id group by 1),
f{k + 1} as (select f.bin_id, f.c / (m.s * f.c) as r, f.r as c from f{k} f join m{k} m using (bin_id))""")
    return "".join(parts) + f"""
select x.bin1_id, x.bin2_id, {rnd('x.count * a.r * b.c', 6)} as balanced
from full_x x join f{passes} a on a.bin_id = x.bin1_id join f{passes} b on b.bin_id = x.bin2_id"""


def rebased(names: list[str], extra: str = "true") -> str:
    """Pixels among chosen chromosomes with ids re-based in the given order."""
    order = ", ".join(f"('{name}', {k})" for k, name in enumerate(names))
    return f""",
chosen as (select c.*, v.k, coalesce(sum(c.hi - c.lo) over (order by v.k rows between unbounded preceding
                  and 1 preceding), 0) as offs
           from chroms c join (values {order}) v(chrom, k) on c.chrom = v.chrom)
select cast(least(bin1_id - a.lo + a.offs, bin2_id - b.lo + b.offs) as int) as bin1_id,
       cast(greatest(bin1_id - a.lo + a.offs, bin2_id - b.lo + b.offs) as int) as bin2_id, count
from pixels join chosen a on bin1_id >= a.lo and bin1_id < a.hi
            join chosen b on bin2_id >= b.lo and bin2_id < b.hi where {extra}"""


TRIANGLE_SQL = "from pixels where bin1_id < bin2_id"
ORIENTED = """,
oriented as (select row_id as bin1_id, col_id as bin2_id, count(*) as count from contacts group by 1, 2),
onull as (select o.bin1_id, o.bin2_id, case when a.weight is not null and b.weight is not null then o.count end as value
          from oriented o join bins a on a.bin_id = o.bin1_id join bins b on b.bin_id = o.bin2_id)
"""

RANKED = ALL_PAIRS + """,
ranked as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as ra,
                  rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 as rb from model)
"""

LIKELIHOOD_SUMS = """(select sum(a) as ta, sum(b) as tb,
  sum(a * ln(b)) as ab, sum(case when a > 0 then a * ln(a) end) as aa,
  sum(case when a > 0 then a * ln(b) end) as ab_pos, sum(a) as ua from model)"""

SQL: dict[str, str] = {}


def add(name: str, body: str, base: str = BASE) -> None:
    SQL[name] = base + body


add("chrom_lengths", "select chrom, max(bin_id) + 1 - min(bin_id) as n_bins from bins group by 1")
add("chrom_lengths_all_no_ym", "select chrom, max(bin_id) + 1 - min(bin_id) as n_bins from bins where chrom <> 'chrY' group by 1")
add("first_excluded_bin", "select min(bin_id) as first_bin from bins where chrom = 'chrY'")
add("usable_bins_by_chrom", "select chrom, bin_id, weight is not null as usable from bins")
add("balancing_coefficients_one_chrom", f"select bin_id, {rnd('weight', 9)} as weight from bins where chrom = 'chr2'")
add("prefix_square_read", "select p.* from pixels p where bin1_id < (select lo from chroms where chrom = 'chrY') "
                          "and bin2_id < (select lo from chroms where chrom = 'chrY')")
add("cis_block_balanced", f"select bin1_id, bin2_id, count, {rnd('value', 9)} as balanced from balanced where c1 = 1 and c2 = 1")
add("balanced_pixels", f"select bin1_id, bin2_id, count, {rnd('value', 9)} as balanced from balanced")
add("multi_chrom_rebased", rebased(["chr1", "chrX"]))
add("reordered_chroms_rebased", rebased(["chrX", "chr1"]))
add("trans_only_pixels", rebased(["chr1", "chr2", "chrX"], "a.chrom <> b.chrom"))
add("selected_bins_rebased", """,
chosen as (select 'chrX' as chrom, 0 as k, 0 as offs union all
           select 'chr1', 1, (select hi - lo from chroms where chrom = 'chrX'))
select cast(bin_id - lo + offs as int) as bin_id, k as chrom_idx, b.chrom from bins b join chosen using (chrom)""")

add("dedup_sum", "select bin1_id, bin2_id, count(*) as count from contacts group by 1, 2")
add("dedup_remove", "select bin1_id, bin2_id, max(count) as count from reps group by 1, 2 having count(*) = 1")
add("dedup_first", "select bin1_id, bin2_id, count from (select *, row_number() over (partition by bin1_id, bin2_id "
                   "order by replicate) as k from reps) where k = 1")
add("null_diagonal", "select bin1_id, bin2_id, case when bin1_id <> bin2_id then count end as count from pixels")
add("symmetrise_max_no_diag", ORIENTED + """
select least(bin1_id, bin2_id) as bin1_id, greatest(bin1_id, bin2_id) as bin2_id,
       case when any_value(bin1_id = bin2_id) or bool_or(value is null) then null else max(value) end as value
from onull group by 1, 2""")
add("remove_unusable_bins", "select bin1_id, bin2_id, count as value from ends where w1 is not null and w2 is not null")
add("mirror_full", MIRROR.format(v="count", t="pixels"))
add("triangle_without_diagonal", f"select * {TRIANGLE_SQL}")
add("merge_by_diagonal", "select bin2_id as bin1_id, bin1_id as bin2_id, count as value from halves where replicate = 1 and "
    "bin1_id < bin2_id union all select bin1_id, bin2_id, count from halves where replicate = 2 and bin1_id < bin2_id")
add("zeros_to_null", "select bin1_id, bin2_id, replicate, nullif(count - 1, 0) as extra from reps")
add("row_totals", f"select bin1_id as bin_id, cast(sum(count) as bigint) as total from ({MIRROR.format(v='count', t='pixels')}) group by 1")
add("marginal_filter", f""",
strong as (select bin1_id as bin_id from ({MIRROR.format(v='count', t='pixels')}) group by 1 having sum(count) >= 230)
select bin1_id, bin2_id, case when bin1_id in (select bin_id from strong) and bin2_id in (select bin_id from strong)
                              then count end as count from pixels""")
add("expand_by_mask", f"select b.bin_id, {STATE_VALUES} from bins b left join states s using (bin_id)")
add("expand_matrix_by_mask", f"select a.bin_id as bin1_id, b.bin_id as bin2_id, {rnd('c.value', 9)} as value "
    "from bins a join bins b on a.bin_id < b.bin_id left join cells c on c.bin1_id = a.bin_id and c.bin2_id = b.bin_id")

add("coarsen", """,
moved as (select c.*, cast(offs as int) as offs from (select *, coalesce(sum((hi - lo + 2) // 3) over (order by chrom_idx
    rows between unbounded preceding and 1 preceding), 0) as offs from chroms) c)
select (bin1_id - a.lo) // 3 + a.offs as bin1_id, (bin2_id - b.lo) // 3 + b.offs as bin2_id,
       cast(sum(count) as bigint) as count
from pixels join moved a on bin1_id >= a.lo and bin1_id < a.hi
            join moved b on bin2_id >= b.lo and bin2_id < b.hi group by 1, 2""")
add("chr_select_fit", f""",
size as (select max(case when chrom_idx = 2 then hi - lo end) as x, max(case when chrom_idx = 0 then hi - lo end) as a,
                max(case when chrom_idx = 2 then lo end) as x_lo from chroms),
moved as (
  select bin_id - x_lo as bin_id, p0, p1, p2 from states, size where c = 2
  union all select bin_id + x, p0, p1, p2 from states, size where c = 0
  union all select bin_id - x_lo + x + a, p0, p1, p2 from states, size where c = 2)
select bin_id, {STATE_VALUES} from moved""")
add("stretch_fit_ffill", f""",
target as (select c.*, 2 * (hi - lo) - 1 as len,
    coalesce(sum(2 * (hi - lo) - 1) over (order by chrom_idx rows between unbounded preceding and 1 preceding), 0) as offs
  from chroms c),
fine as (
  select bin_id, chrom_idx, coarse from (
    select t.offs + (p_partkey * 2 // width - t.lo * 2) as bin_id, t.chrom_idx,
           t.lo + (p_partkey * 2 // width - t.lo * 2) // 2 as coarse, p_size
    from part, sizes, target t
    where p_partkey // width >= t.lo and p_partkey // width < t.hi and p_partkey * 2 // width - t.lo * 2 < t.len)
  group by 1, 2, 3 having max(p_size) >= 8),
filled as (
  select f.bin_id, coalesce(last_value(s.p0 ignore nulls) over w, 1.0) as p0,
         coalesce(last_value(s.p1 ignore nulls) over w, 0.0) as p1,
         coalesce(last_value(s.p2 ignore nulls) over w, 0.0) as p2
  from fine f left join states s on s.bin_id = f.coarse
  window w as (partition by f.chrom_idx order by f.bin_id rows between unbounded preceding and current row))
select cast(bin_id as int) as bin_id, {STATE_VALUES} from filled""")
add("stretch_fit_plain", f"select cast(bin_id * 2 + k as int) as bin_id, {STATE_VALUES} from all_states, (values (0), (1)) v(k)")
add("state_sort", f"select bin_id, {rnd('p1', 9)} as p0, {rnd('p2', 9)} as p1, {rnd('p0', 9)} as p2 from states")
add("rebin_ids", "select distinct bin_id // 5 as bin_id from good")

add("distance_normalised", NORMALISED + f"select bin1_id, bin2_id, {rnd('value', 9)} as balanced, {rnd('normalised', 12)} as normalised from normed")
add("usable_pairs_by_distance", "select b.bin_id - a.bin_id as distance, count(*) as pairs from good a join good b "
    "on a.bin_id < b.bin_id group by 1")
add("decay_only_matrix", NORMALISED + f"select bin1_id, bin2_id, {rnd('value / nullif(normalised, 0)', 3)} as decay from normed")
add("normalise_l1_triangle", f"select bin1_id, bin2_id, {rnd('value / sum(value) over ()', 12)} as value from cells where bin1_id < bin2_id")
add("normalise_rows", f"select bin1_id, bin2_id, {rnd('value / sum(value) over (partition by bin1_id)', 9)} as share "
    f"from ({MIRROR.format(v='value', t='cells')})")
add("safe_log_counts", f"select bin1_id, bin2_id, {rnd('ln(value + (select min(nullif(value, 0)) from cells) / 10)', 9)} as ln_value from cells")
add("safe_divide", f"select bin1_id, bin2_id, round(nullif(a, 0) / nullif(b, 0), 9) as ratio from (select bin1_id, bin2_id, "
    "sum(case when replicate = 1 then count else 0 end)::double as a, "
    "sum(case when replicate = 2 then count else 0 end)::double as b from halves group by 1, 2)")
add("balance_k_passes", balance_sql(3))
add("balance_converged", f"select distinct bin1_id as bin_id, 1.0::double as mean from ({MIRROR.format(v='count', t='pixels')})")
add("balance_by_coefficients", f"select bin1_id, bin2_id, {rnd('value', 9)} as value from balanced")

add("model_terms", f"select bin1_id, bin2_id, cis, {rnd('g', 9)} as compartment, {rnd('ln_decay_r', 9)} as ln_decay, "
    f"{rnd('ln(g) + ln_decay_r', 9)} as ln_p from counted")
add("generate_matrix", ALL_PAIRS + f"select bin1_id, bin2_id, {rnd('b', 13)} as value from model")
add("generate_slice", f"""
select bin1_id, bin2_id, {rnd('g * exp(ln_decay)', 12)} as value from terms, sizes
where (bin1_id >= n // 5 and bin1_id < n // 2 and bin2_id >= n // 3)
   or (bin2_id >= n // 5 and bin2_id < n // 2 and bin1_id >= n // 3 and not (bin1_id >= n // 5 and bin1_id < n // 2))""")
add("generate_chromosome", f"select bin1_id, bin2_id, {rnd('g * exp(ln_decay) / sum(g * exp(ln_decay)) over ()', 12)} as value "
    "from terms where c1 = 1 and c2 = 1")
add("generate_selected_chromosomes", f""",
size as (select max(case when chrom_idx = 2 then hi - lo end) as x, max(case when chrom_idx = 2 then lo end) as x_lo from chroms),
moved as (select case when c1 = 2 then bin1_id - x_lo else bin1_id + x end as m1,
                 case when c2 = 2 then bin2_id - x_lo else bin2_id + x end as m2, g * exp(ln_decay) as v
          from terms, size where c1 in (0, 2) and c2 in (0, 2))
select cast(least(m1, m2) as int) as bin1_id, cast(greatest(m1, m2) as int) as bin2_id, {rnd('v', 12)} as value from moved""")
add("compartment_only_matrix", f""",
g as (select bin1_id, bin2_id, 0.36*a0*b0 + 0.24*a1*b1 + 0.3*a2*b2 + 0.08*(a0*b1 + a1*b0) + 0.02*(a0*b2 + a2*b0) + 0.06*(a1*b2 + a2*b1) as g from pairs)
select bin1_id, bin2_id, {rnd('g / sum(g) over ()', 12)} as value from g""")
add("decay_only_model", f"select bin1_id, bin2_id, {rnd('exp(ln_decay_r) / sum(exp(ln_decay_r)) over ()', 12)} as value from terms")
add("logsumexp_by_area", f""",
top as (select cis, max(ln(g) + ln_decay) as m from counted group by 1)
select cis, {rnd('ln(sum(exp(ln(g) + ln_decay - m))) + any_value(m)', 9)} as lse from counted join top using (cis) group by 1""")
add("exact_decimal_sum", "select l_returnflag, cast(sum(cast(l_extendedprice as decimal(28, 6))) as double) as total from lineitem group by 1", "")

LIMBS = ["l0 as (select l_returnflag, cast(floor(log2(abs(x)) / 32) as int) + 1 as k, x as rest from priced where x <> 0)"]
for _i in range(1, 5):
    LIMBS.append(f"l{_i} as (select l_returnflag, k - 1 as k, k as limb, trunc(rest * pow(2.0::double, -16 * k) * pow(2.0::double, -16 * k)) as q, "
                 f"rest - trunc(rest * pow(2.0::double, -16 * k) * pow(2.0::double, -16 * k)) * pow(2.0::double, 16 * k) * pow(2.0::double, 16 * k) as rest from l{_i - 1})")
add("exact_float_limbs", "with priced as (select l_returnflag, cast(l_extendedprice * (1.0::double - l_discount) / l_quantity as double) as x from lineitem), "
    + ", ".join(LIMBS) + " select l_returnflag, limb, cast(sum(cast(q as hugeint)) as double) as total from ("
    + " union all ".join(f"select l_returnflag, limb, q from l{i}" for i in range(1, 5)) + ") where q <> 0 group by 1, 2", "")
add("zero_counts_both", ZEROS + "select g.bin_id, count(z.bin2_id) as zeros from good g left join zeros z on z.bin1_id = g.bin_id group by 1")
add("zero_counts_trans", ZEROS + "select g.bin_id, count(z.bin2_id) as zeros from good g left join (select * from zeros where c1 <> c2) z "
    "on z.bin1_id = g.bin_id group by 1")
add("zero_candidates_both", ZEROS + "select bin1_id, bin2_id from zeros")
add("zero_candidates_trans", ZEROS + "select bin1_id, bin2_id from zeros where c1 <> c2")
add("zero_sample_keyed", ZEROS + "select bin1_id, bin2_id from zsample")
add("zero_sample_drawn", ZEROS + "select bin1_id, bin2_id from ztrans")

add("dense_log_likelihood", ALL_PAIRS + f"select {rnd('sum(case when x > 0 then x * (ln(g) + ln_decay_r) end) - sum(x) * ln(sum(mr))', 3)} "
    f"as log_likelihood, {rnd('ln(sum(mr))', 9)} as ln_z from allp")
add("dense_gradient_states", ALL_PAIRS + gradient_states("allp", "x", "mr", "dr"))
add("dense_gradient_shared", ALL_PAIRS + gradient_shared("allp", "x", "mr", "dr", "ln_dr", True))
SPARSE = ZEROS + """,
sp as (select *, exp(ln_decay) * times as dt, g * exp(ln_decay) * times as mt from weighted)
"""
add("sparse_log_likelihood", SPARSE + f"select {rnd('sum(case when x > 0 then x * (ln(g) + ln_decay) end) - sum(x) * ln(sum(mt))', 3)} "
    f"as log_likelihood, {rnd('ln(sum(mt))', 9)} as ln_z from sp")
add("sparse_gradient_states", SPARSE + gradient_states("sp", "x", "mt", "dt"))
add("sparse_gradient_shared", SPARSE + gradient_shared("sp", "x", "mt", "dt", "ln_d", False))
STEPS = """,
steps as (select p0 - lag(p0) over w as d0, p1 - lag(p1) over w as d1, p2 - lag(p2) over w as d2
          from states window w as (order by bin_id))
"""
add("regulariser_terms", STEPS + f"""
select {rnd('(select count(*) from states) * (select sum(abs(d0) + abs(d1) + abs(d2)) from steps)', 3)} as l1diff,
       {rnd('-(select count(*) from states) * (select sum(abs(p0 - 0.5) + abs(p1 - 0.5) + abs(p2 - 0.5)) from states)', 3)} as nonuniform""")
add("difference_gram", STEPS + " union all ".join(
    f"select {s} as s1, {t} as s2, {rnd(f'sum(d{s} * d{t})', 7)} as g from steps" for s in range(3) for t in range(3)))

def split_tree(name: str, source: str, n: str, seed: int, law: str, height: int = 24) -> str:
    """CTEs of a keyed draw by a splitting tree: ``name`` is (bin1_id, bin2_id, count), one step a level."""
    low, high, above, under = {
        "hypergeometric": ("greatest(0, quota - b)", "least(quota, a)", "(a - k + 1)::double * (quota - k + 1)", "k::double * (b - quota + k)"),
        "binomial": ("0", "quota", "(quota - k + 1) * a", "k * b")}[law]
    kind = "bigint" if law == "hypergeometric" else "double"
    steps = [f"""
{name}_cells as materialized (
  select bin1_id, bin2_id, amt, row_number() over (order by bin1_id, bin2_id) - 1 as number from ({source}) where amt > 0),
{name}_q{height} as materialized (select 0::bigint as idx, {n} as quota)"""]
    for h in range(height, 0, -1):
        steps.append(f"""
{name}_s{h} as materialized (select number >> {h - 1} as idx, cast(sum(amt) as {kind}) as amt from {name}_cells group by 1),
{name}_n{h} as materialized (
  select q.idx, quota, coalesce(l.amt, 0) as a, coalesce(r.amt, 0) as b,
         cast('0x' || substr(md5(concat_ws(':', '{seed}', '{h}', q.idx)), 1, 13) as bigint) / 4503599627370496.0::double as u
  from {name}_q{h} q left join {name}_s{h} l on l.idx = 2 * q.idx left join {name}_s{h} r on r.idx = 2 * q.idx + 1 where quota > 0),
{name}_k{h} as (
  select idx, quota, a, b, u, {low} as low, unnest(range({low}, {high} + 1)) as k from {name}_n{h} where a > 0 and b > 0),
{name}_l{h} as (
  select idx, u, k, sum(case when k > low then ln({above}) - ln({under}) else 0.0 end) over (partition by idx order by k) as lnp from {name}_k{h}),
{name}_w{h} as (select idx, u, k, exp(lnp - max(lnp) over (partition by idx)) as w from {name}_l{h}),
{name}_c{h} as (select idx, u, k, sum(w) over (partition by idx order by k) as c, sum(w) over (partition by idx) as t from {name}_w{h}),
{name}_p{h} as materialized (select idx, min(k) as k from {name}_c{h} where c > u * t group by idx),
{name}_q{h - 1} as materialized (
  select 2 * idx as idx, case when b > 0 then coalesce(k, 0) else quota end as quota from {name}_n{h} left join {name}_p{h} using (idx)
  union all select 2 * idx + 1, quota - case when b > 0 then coalesce(k, 0) else quota end from {name}_n{h} left join {name}_p{h} using (idx))""")
    steps.append(f"""
{name} as (select bin1_id, bin2_id, quota::bigint as count from {name}_cells join {name}_q0 on idx = number where quota > 0)""")
    return ",".join(steps)


THINNED = "," + split_tree("thin", "select bin1_id, bin2_id, count as amt from pixels where bin1_id < bin2_id",
                           "(select cast(floor(sum(count) * 0.3::double) as bigint) from pixels where bin1_id < bin2_id)", 3, "hypergeometric")
add("downsample_keyed", THINNED + """
select bin1_id, bin2_id, count from thin""")
add("resample_multinomial", ALL_PAIRS + "," + split_tree("draws", "select bin1_id, bin2_id, b as amt from model",
                                                         "(select cast(sum(count) as bigint) from pixels)", 3, "binomial")
    + " select bin1_id, bin2_id, count from draws")
add("resample_inverse_cdf", ALL_PAIRS + """,
total as materialized (select (select sum(b) from model) as mass, (select cast(sum(count) as bigint) from pixels) as n_reads),
cum as materialized (select bin1_id, bin2_id, coalesce(sum(b) over (order by bin1_id, bin2_id rows between unbounded preceding
        and 1 preceding), 0.0) as low from model),
draws as materialized (select cast('0x' || substr(md5('3:' || id), 1, 13) as ubigint)::double / 4503599627370496.0
                 * mass as u from total, (select unnest(range(n_reads)) as id from total)),
merged as (select low as pos, 0 as kind, bin1_id, bin2_id from cum union all select u, 1, null, null from draws),
placed as (select kind, last_value(bin1_id ignore nulls) over w as bin1_id, last_value(bin2_id ignore nulls) over w as bin2_id
           from merged window w as (order by pos, kind rows between unbounded preceding and current row))
select bin1_id, bin2_id, count(*) as count from placed where kind = 1 group by 1, 2""")
add("read_totals_ratio", f"select cast(sum(count) as bigint) as total, {rnd('sum(count) * 0.3::double', 6)} as reads "
    "from ends where bin1_id < bin2_id and w1 is not null and w2 is not null")

add("pearson_data_model", ALL_PAIRS + f"select {rnd('corr(a, b)', 9)} as pearson from model")
add("spearman_data_model", RANKED + f"select {rnd('corr(ra, rb)', 9)} as spearman from ranked")
add("pearson_replicates", f""",
couple as (select a.bin_id as bin1_id, b.bin_id as bin2_id, coalesce(x.count, 0)::double as x, coalesce(y.count, 0)::double as y
         from good a join good b on a.bin_id < b.bin_id
         left join halves x on x.bin1_id = a.bin_id and x.bin2_id = b.bin_id and x.replicate = 1
         left join halves y on y.bin1_id = a.bin_id and y.bin2_id = b.bin_id and y.replicate = 2)
select {rnd('corr(x, y)', 9)} as pearson from couple""")
add("fit_likelihood", ALL_PAIRS + f"select {rnd('(ab - ln(tb) * ua) / ta', 9)} as likelihood from {LIKELIHOOD_SUMS}")
RATIO = ALL_PAIRS + f"select {rnd('exp((ab_pos - ln(tb) * ua) / ta - (aa - ln(ta) * ua) / ta)', 9)} as likelihood_ratio from {LIKELIHOOD_SUMS}"
add("likelihood_ratio", RATIO)
add("likelihood_ratio_single_cell", RATIO)
add("lambda_diff_min_permutation", ", q as (select p0, p1, p2, p2 as q0, (p0 + p1) * 0.75 as q1, (p0 + p1) * 0.25 as q2 from states) "
    "select " + rnd("least(" + ", ".join(
        "(" + " + ".join(f"avg(abs(p{s} - q{t}))" for s, t in enumerate(perm)) + ") / 3"
        for perm in ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0))) + ")", 9)
    + " as state_difference from q")
add("parametric_normalisation", ALL_PAIRS + f""",
means as (select bin2_id - bin1_id as d, avg(b) as m from model group by 1),
total as (select sum(b / m) as t from model join means on bin2_id - bin1_id = d)
select bin1_id, bin2_id, {rnd('a * (b / m / t / b)', 6)} as parametric
from model join means on bin2_id - bin1_id = d, total where a > 0""")
add("accuracy_table", RANKED + f""",
na as (select bin2_id - bin1_id as d, avg(a) as ma, avg(b) as mb from model group by 1),
nrm as (select case when ma = 0 then 0 else a / ma end as a, b / mb as b from model join na on bin2_id - bin1_id = d),
nrk as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as ra,
               rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 as rb from nrm)
select 'data' as "case", 'pearson' as metric, {rnd('corr(a, b)', 7)} as value from model
union all select 'data', 'spearman', {rnd('corr(ra, rb)', 7)} from ranked
union all select 'data', 'normalised_pearson', {rnd('corr(a, b)', 7)} from nrm
union all select 'data', 'normalised_spearman', {rnd('corr(ra, rb)', 7)} from nrk
union all select 'data', 'likelihood', {rnd('(ab - ln(tb) * ua) / ta', 7)} from {LIKELIHOOD_SUMS}
union all select 'data', 'lr', {rnd('exp((ab_pos - ln(tb) * ua) / ta - (aa - ln(ta) * ua) / ta)', 7)} from {LIKELIHOOD_SUMS}""")
add("accuracy_per_chromosome", ALL_PAIRS + f"select c1 as chrom_idx, {rnd('corr(a, b)', 9)} as pearson from model where c1 = c2 group by 1")
add("accuracy_of_thinned_data", ALL_PAIRS + THINNED + f""",
side as (select m.bin1_id, m.bin2_id, coalesce(t.count, 0)::double as a, m.b from model m left join thin t using (bin1_id, bin2_id))
select 0.3::double as rate, 'pearson' as metric, {rnd('corr(a, b)', 8)} as value from side
union all select 0.3::double, 'lr', {rnd('exp((ab_pos - ln(tb) * ua) / ta - (aa - ln(ta) * ua) / ta)', 8)}
from {LIKELIHOOD_SUMS.replace('from model', 'from side')}""")
RUNS = ALL_PAIRS + "".join(
    "," + split_tree(f"run{k}", "select bin1_id, bin2_id, b as amt from model", "(select cast(sum(count) as bigint) from pixels)", 3 + k, "binomial")
    for k in (1, 2))
SIDE_LR = "exp((sum(case when a > 0 then a * ln(b) end) - ln(sum(b)) * sum(a)) / sum(a) - (sum(case when a > 0 then a * ln(a) end) - ln(sum(a)) * sum(a)) / sum(a))"
add("accuracy_genome_wide", RUNS + f""",
drawn as (select 0 as run, bin1_id, bin2_id, count from pixels union all select 1, * from run1 union all select 2, * from run2),
side as materialized (
  select r.run, m.c1 as chrom_idx, m.bin2_id - m.bin1_id as d, coalesce(t.count, 0)::double as a, m.b
  from model m join (values (0), (1), (2)) r(run) on m.c1 = m.c2
  left join drawn t on t.run = r.run and t.bin1_id = m.bin1_id and t.bin2_id = m.bin2_id),
means as (select run, chrom_idx, d, avg(a) as ma, avg(b) as mb from side group by all),
scaled as (select run, chrom_idx, case when ma = 0 then 0 else a / ma end as a, b / mb as b from side join means using (run, chrom_idx, d))
select run, chrom_idx, 'pearson' as metric, {rnd('corr(a, b)', 7)} as value from side group by 1, 2 having sum(a) > 0
union all select run, chrom_idx, 'lr', {rnd(SIDE_LR, 7)} from side group by 1, 2 having sum(a) > 0
union all select run, chrom_idx, 'normalised_pearson', {rnd('corr(a, b)', 7)} from scaled group by 1, 2 having sum(a) > 0""")
THIN_RATES = ALL_PAIRS + "".join(
    "," + split_tree(f"rate{rate}", "select bin1_id, bin2_id, count as amt from pixels where bin1_id < bin2_id",
                     f"(select cast(floor(sum(count) * {rate / 100}::double) as bigint) from pixels where bin1_id < bin2_id)", 3, "hypergeometric")
    for rate in (10, 30, 60))
add("accuracy_thinning_grid", THIN_RATES + f""",
drawn as (select 10 as percent, * from rate10 union all select 30, * from rate30 union all select 60, * from rate60),
side as materialized (
  select r.percent, coalesce(t.count, 0)::double as a, m.b from model m join (values (10), (30), (60)) r(percent) on true
  left join drawn t on t.percent = r.percent and t.bin1_id = m.bin1_id and t.bin2_id = m.bin2_id)
select percent, 'pearson' as metric, {rnd('corr(a, b)', 7)} as value from side group by 1
union all select percent, 'lr', {rnd(SIDE_LR, 7)} from side group by 1""")
add("accuracy_single_cells", ALL_PAIRS + f""",
cellp as (select cell_id, bin1_id, bin2_id, count(*)::double as a from contacts group by all),
own as (select count(*)::double as n, sum(b) as sb, sum(b * b) as sbb from model),
sums as (select cell_id, sum(x.a) as sa, sum(x.a * x.a) as saa, sum(x.a * m.b) as sab, sum(x.a * ln(m.b)) as ab, sum(x.a * ln(x.a)) as aa
         from cellp x join model m using (bin1_id, bin2_id) group by 1)
select cell_id, 'pearson' as metric, {rnd('(sab - sa * sb / n) / sqrt(saa - sa * sa / n) / sqrt(sbb - sb * sb / n)', 7)} as value from sums, own
union all select cell_id, 'lr', {rnd('exp((ab - aa - (ln(sb) - ln(sa)) * sa) / sa)', 7)} from sums, own""")
add("likelihood_residuals", ALL_PAIRS + f"select bin1_id, bin2_id, {rnd('x - reads / z * mr', 8)} as residual "
    "from allp, mass where x > 0")
add("compact_index", "select bin_id, row_number() over (order by bin_id) - 1 as index from good")
add("row_correlation", NORMALISED + f""",
fullm as ({MIRROR.format(v='normalised', t='normed')}),
mom as (select bin1_id as bin_id, sum(normalised) as s, sum(normalised * normalised) as q from fullm group by 1),
num as (select count(*)::double as n from good),
spread as (select bin_id, s, n * q - s * s as v from mom, num where n * q - s * s > 0),
prod as (select a.bin1_id as i, b.bin1_id as j, sum(a.normalised * b.normalised) as p
         from fullm a join fullm b on a.bin2_id = b.bin2_id and a.bin1_id <= b.bin1_id group by 1, 2)
select a.bin_id as bin1_id, b.bin_id as bin2_id,
       {rnd('(n * coalesce(p, 0) - a.s * b.s) / sqrt(a.v) / sqrt(b.v)', 8)} as correlation
from spread a join spread b on a.bin_id <= b.bin_id left join prod on i = a.bin_id and j = b.bin_id, num""")
add("pca_reconstruction", f"select a.bin_id as bin1_id, b.bin_id as bin2_id, {rnd('(a.p0 - a.p1) * (b.p0 - b.p1)', 9)} as value "
    "from states a join states b on a.bin_id <= b.bin_id")

add("row_groups", GROUPS + "select bin_id, name as row_group from grp")
add("band_mask_rows", GROUPS + f"""
select f.bin1_id, f.bin2_id, case when abs(f.bin1_id - f.bin2_id) <= 4 then 0 else count end as count
from ({MIRROR.format(v='count', t='pixels')}) f join grp on grp.bin_id = f.bin1_id where name = 'mixed'""")
add("bulk_profile", GROUPS + profile_cte("bulk", "cells") + f"select profile, col, {rnd('p', 12)} as p from bulk_p")
add("cell_read_counts", GROUPS + VECTORS + "select cell_id, cast(sum(count) as bigint) as reads, sum(count) >= 5 as enough from vec group by 1")
add("profile_log_likelihood", GROUPS + profile_cte("bulk", "cells") + VECTORS + scores("bulk")
    + f"select cell_id, profile, {rnd('score', 5)} as score from bulk_score")
add("mixed_log_ratio", NORMALISED + ", decays as (select bin1_id, bin2_id, value / nullif(normalised, 0) as value from normed)"
    + GROUPS + profile_cte("bulk", "cells") + profile_cte("dd", "decays") + VECTORS + scores("bulk") + scores("dd")
    + f"select cell_id, {rnd('a.lr - b.lr', 5)} as mlr from bulk_lr a join dd_lr b using (cell_id)")

add("top_n_fits", 'select cast(row_number() over (order by s_acctbal, s_suppkey) as int) as "rank", s_suppkey as fit_id, '
    "s_acctbal as optimize_value from supplier order by s_acctbal, s_suppkey limit 5", "")
add("best_of_fits", "select s_suppkey as fit_id, s_acctbal as optimize_value from supplier order by s_acctbal, s_suppkey limit 1", "")
