"""SQL twins of the registered queries, for an independent engine on the same tables.

Without a twin are the randomized searches and what is built on them, the noise, and two filters of
grown rasters, which take SQL minutes; their smaller forms have twins.
"""

from __future__ import annotations

from pixelweave.functions import streams

_SQ = "240 + coalesce(q, 0) % 3856"
RAW = f"""cells as (select y, x from range(32) a(y), range(32) b(x)),
sums as (select l_orderkey % 32 y, l_partkey % 32 x, cast(sum(l_quantity) as bigint) q from lineitem group by 1, 2),
raw as (select 0 img, cast(y as int) y, cast(x as int) x, cast({_SQ} as int) v from cells left join sums using (y, x)),
normal as (select img, y, x, least(greatest((cast(v as double) - 240) / 3855, 0), 1) v from raw)"""
FRAMES = f"""fcells as (select i img, y, x from range(1, 8) c(i), range(16) a(y), range(16) b(x)),
fsums as (select cast(l_linenumber as bigint) img, l_orderkey % 16 y, l_partkey % 16 x, cast(sum(l_quantity) as bigint) q from lineitem group by 1, 2, 3),
frames as (select cast(img as int) img, cast(y as int) y, cast(x as int) x, cast({_SQ} as int) v from fcells left join fsums using (img, y, x)),
clean as (select y, x, cast(floor(avg(v)) as int) clean from frames group by 1, 2),
pairs as (select img, y, x, v, clean from frames join clean using (y, x)),
rgb as (select y, x, max(case when img = 1 then v % 256 end) r, max(case when img = 2 then v % 256 end) g, max(case when img = 3 then v % 256 end) b from frames group by 1, 2),
stats as (select y, x, avg(v - 240.0::double) m, var_samp(v - 240.0::double) var from frames group by 1, 2)"""
EMB = "e as (select 0 img, cast(vec_id as int) y, cast(unnest(range(len(embedding))) as int) x, cast(unnest(embedding) as double) v from embeddings)"
_ISO = "case event_type when 'signup' then 1600 when 'view' then 3200 when 'error' then 6400 when 'click' then 12800 else 25600 end"
PARAMS = f"""params as (select 'scene' || (user_id % 11 + 1) scene, {_ISO} iso, cast(event_id % 7 + 1 as int) frame, cast(event_id % 10 as int) noisy_idx,
event_id, value a, round(value - 20, 2) b from events)"""
RESULTS = f"results as (select event_type method, {_ISO} iso, cast(event_id % 7 + 1 as int) frame, value psnr from events)"
PACKED = "packed as (select img, cast(y // 2 as int) y, cast(x // 2 as int) x, cast(y % 2 * 2 + x % 2 as int) ch, v from raw)"
A, B = 0.002, 0.00005
_VST = "2 * sqrt(greatest(v / {a} + 0.375 + {b} / ({a} * {a}), 0))"


def _stable(a: float, b: float) -> str:
    return _VST.format(a=f"{a}::double", b=f"{b}::double")


def _u8(v: str) -> str:
    return f"cast(floor(least(greatest({v}, 0), 255)) as int)"


def _near(v: str) -> str:
    return f"cast(floor(least(greatest({v}, 0), 255) + 0.5) as int)"


_N01 = "least(greatest((cast({} as double) - 240) / 3855, 0), 1)"
_Y = "(r * 0.299::double + g * 0.587::double + b * 0.114::double)"
_DCT = f"""{EMB}, p as (select y, cast(x // 8 as int) i, cast(x % 8 as int) j, v from e),
basis as (select k, n, case when k = 0 then sqrt(1 / 8.0::double) else sqrt(2 / 8.0::double) end * cos(pi() * (2 * n + 1) * k / 16.0::double) c from range(8) a(k), range(8) b(n)),
spectrum as (select y, cast(a.k as int) i, cast(b.k as int) j, sum(a.c * b.c * v) v from p join basis a on a.n = i join basis b on b.n = j group by 1, 2, 3),
kept as (select y, i, j, case when abs(v) < 0.1 then 0 else v end v from spectrum)"""

ORACLE_SQL: dict[str, str] = {
    "raw_normalize": f"with {RAW} select img, y, x, round(v, 6) v from normal",
    "vst_forward": f"with {RAW} select img, y, x, round({_stable(A, B)}, 6) v from normal",
    "gat_forward": f"with {RAW} select img, y, x, round({_stable(A, 0.01 * 0.01)}, 6) v from normal",
    "gat_inverse_asym": f"with {RAW}, s as (select img, y, x, {_stable(A, 0.01 * 0.01)} d from normal) select img, y, x, round({A}::double * (d * d / 4 - 0.125 - 0.0001::double / ({A}::double * {A}::double)), 6) v from s",
    "vst_inverse_alg": f"with {RAW}, s as (select img, y, x, {_stable(A, B)} d from normal) select img, y, x, round({A}::double * (d * d / 4 - 0.375 - {B}::double / ({A}::double * {A}::double)), 6) v from s",
    "quantize_u16": f"with {RAW} select img, y, x, cast(floor(least(greatest(round(v * 0.9::double, 9) * 3855 + 240, 0), 4095)) as int) v from normal",
    "quantize_u8": f"with {RAW} select img, y, x, {_u8('v * 255.0::double / 4095.0::double')} cut, {_near('v * 255.0::double / 4095.0::double')} near, cast(v // 256 as int) high from raw",
    "param_units": f"with {PARAMS} select event_id, round(a / 3855.0::double, 9) a_norm, round(greatest(b, 0) / (3855.0::double * 3855), 9) b_var, round(sqrt(greatest(b, 0)) / 3855.0::double, 9) b_std from params",
    "srgb_gamma": f"with {RAW} select img, y, x, round(case when v <= 0.0031308 then v * 12.92::double else pow(v, 1 / 2.4::double) * 1.055::double - 0.055::double end, 6) v from normal",
    "ycrcb": f"with {FRAMES} select y, x, {_near(_Y)} luma, {_near(f'(r - {_Y}) * 0.713::double + 128')} cr, {_near(f'(b - {_Y}) * 0.564::double + 128')} cb from rgb",
    "wb_ccm": f"""with {FRAMES}, w as (select y, x, least(r / 255.0::double * 2.394::double, 1) r, least(g / 255.0::double, 1) g, least(b / 255.0::double * 1.597::double, 1) b from rgb)
select y, x, round(least(greatest(1.9712::double * r - 0.7503::double * g - 0.2209::double * b, 0), 1), 6) r, round(least(greatest(-0.2491::double * r + 1.4727::double * g - 0.2236::double * b, 0), 1), 6) g,
round(least(greatest(0.0172::double * r - 0.4864::double * g + 1.4692::double * b, 0), 1), 6) b from w""",
    "method_noise": f"with {FRAMES} select img, y, x, {_u8('v / 16.0::double - clean / 16.0::double + 128')} v from pairs",
    "residual": f"with {FRAMES} select img, y, x, round(least(abs({_N01.format('v')} - {_N01.format('clean')}) * 5, 1), 6) v from pairs",
    "max_normalize": f"with {RAW} select img, y, x, round(case when max(v) over (partition by img) > 10 then v / cast(max(v) over (partition by img) as double) else v end, 6) v from raw",
    "pack_bayer": f"with {RAW}, {PACKED} select img, y, x, ch, v from packed",
    "unpack_bayer": f"with {RAW} select img, y, x, v from raw",
    "guide_channel": f"with {RAW}, {PACKED} select img, y, x, round(avg(v), 6) mean4, max(case when ch = 0 then v end) ch0 from packed group by 1, 2, 3",
    "mse": f"with {FRAMES} select img, round(avg((v - clean) * (v - clean)::double), 6) mse from pairs group by 1",
    "psnr_raw": f"with {FRAMES}, m as (select img, avg((v - clean) * (v - clean)::double) m from pairs group by 1) select img, round(case when m > 0 then 10 * log10(4095.0::double * 4095 / m) when m = 0 then 'inf'::double end, 6) psnr from m",
    "psnr_norm": f"with {FRAMES}, m as (select img, avg(pow({_N01.format('v')} - {_N01.format('clean')}, 2)) m from pairs group by 1) select img, round(case when m > 0 then 10 * log10(1 / m) when m = 0 then 'inf'::double end, 6) psnr from m",
    "pixel_mean_var": f"with {FRAMES} select y, x, round(m, 6) m, round(var, 6) var from stats",
    "noise_percentiles": f"with {FRAMES} select round(quantile_cont(m, 0.05), 6) lo, round(quantile_cont(m, 0.95), 6) hi from stats",
    "noise_ols": f"""with {FRAMES}, q as (select greatest(quantile_cont(m, 0.05), 0) lo, quantile_cont(m, 0.95) hi from stats)
select count(*) n, round(case when count(*) >= 100 then regr_slope(var, m) end, 4) a, round(case when count(*) >= 100 then regr_intercept(var, m) end, 4) b from stats, q where m between lo and hi and var >= 0""",
    "image_stats": f"with {EMB} select img, round(min(v), 6) lo, round(max(v), 6) hi, round(avg(v), 6) mean, round(stddev_pop(v), 6) sd from e group by 1",
    "summary_by_method": f"with {RESULTS} select method, round(avg(psnr), 4) mean, count(psnr) n from results group by 1",
    "summary_by_iso": f"with {RESULTS} select iso, round(avg(psnr), 4) mean, count(psnr) n from results group by 1",
    "argmin_config": f"with {PARAMS}, c as (select scene, sum(event_id) cost from params group by 1) select scene, cast(cost as bigint) cost from c order by cost, scene limit 1",
    "dct2d": f"with {_DCT} select y, i, j, round(v, 5) v from spectrum",
    "dct_inverse": f"with {EMB} select y, cast(x // 8 as int) i, cast(x % 8 as int) j, round(v, 5) v from e",
    "hard_threshold": f"with {_DCT} select y, i, j, round(v, 5) v from kept",
    "nonzero_count": f"with {_DCT} select y, count(*) filter (v <> 0) n_nz from kept group by 1",
    "match_ssd_topk": f"""with {RAW}, refs as (select y ref_y, x ref_x from range(0, 25, 4) a(y), range(0, 25, 4) b(x)), cand as (select y, x from range(25) a(y), range(25) b(x)),
off as (select i, j from range(8) a(i), range(8) b(j)),
d as (select ref_y, ref_x, c.y, c.x, sum((p.v - q.v) * (p.v - q.v)) dist from refs join cand c on abs(c.y - ref_y) <= 19 and abs(c.x - ref_x) <= 19 and not (c.y = ref_y and c.x = ref_x), off
join raw p on p.y = ref_y + i and p.x = ref_x + j join raw q on q.y = c.y + i and q.x = c.x + j group by all)
select 0 img, cast(ref_y as int) ref_y, cast(ref_x as int) ref_x, cast(rk as int) rk, cast(dist as bigint) dist, cast(y as int) y, cast(x as int) x
from (select *, row_number() over (partition by ref_y, ref_x order by dist, y, x) rk from d) where rk <= 8""",
}
ORACLE_SQL["match_tiled"] = ORACLE_SQL["match_ssd_topk"]


# catalogue, tiles, stencils, matching and groups

_PATHS = """paths as (select distinct 'data/noisy/scene' || (o_custkey % 11 + 1) || '/ISO' || ((o_orderkey % 5 + 1) * 1600) || '/frame' || (o_orderkey % 7 + 1)
|| case when o_orderkey % 11 = 0 then '_clean' else '_noisy' || (o_orderkey % 10) end || '.tiff' path from orders),
files as (select path, regexp_extract(path, '(scene[0-9]+)/', 1) scene, cast(regexp_extract(path, 'ISO([0-9]+)', 1) as int) iso,
cast(regexp_extract(path, 'frame([0-9]+)_', 1) as int) frame, path like '%\\_clean.tiff' escape '\\' is_clean,
case when path like '%noisy%.tiff' and path not like '%clean%' then cast(regexp_extract(path, '_noisy([0-9]+).tiff', 1) as int) end noisy_idx from paths)"""
_FIRST = f"{PARAMS}, firsts as (select * from params qualify row_number() over (partition by scene, iso, frame order by noisy_idx, event_id) = 1)"


def _starts(size: int, block: int, overlap: int) -> str:
    return f"(select distinct least(s, {max(size - block, 0)}) s from range(0, {size}, {block - overlap}) a(s))"


def _mirror(at: str, n: int | str, again: int) -> str:
    """Index beyond the border; `again` is 1 if the edge repeats."""
    return f"case when {at} < 0 then -({at}) - {again} when {at} >= {n} then 2 * {n} - {2 - again} - ({at}) else {at} end"


def _axis(n: int | str, step: int = 1) -> str:
    """Positions before n, which may be a subquery."""
    return f"range(0, {n}, {step})" if isinstance(n, int) else f"(select unnest(range(0, cast({n} as bigint), {step})))"


def _wide(source: str, n: int | str, margin: int, again: int) -> str:
    """wide: a raster continued beyond its border, whose size may be a subquery."""
    return f"""span as materialized (select s, {_mirror('s', n, again)} m from (select unnest(range({-margin}, cast({n} + {margin} as bigint))) s)),
wide as materialized (select img, a.s y, b.s x, v from {source} r join span a on a.m = r.y join span b on b.m = r.x)"""


def _near_wide(source: str, n: str, radius: int, again: int) -> str:
    """`_near` of a raster whose size is a subquery."""
    return f"""{_wide(source, n, radius, again)}, near as (select a.img, a.y, a.x, a.v, dy, dx, b.v nv from {source} a cross join range({-radius}, {radius + 1}) p(dy) cross join range({-radius}, {radius + 1}) q(dx)
join wide b on b.img = a.img and b.y = a.y + dy and b.x = a.x + dx)"""


def _near(source: str, n: int, radius: int, again: int | None) -> str:
    """near: each pixel of a raster with those around it."""
    y, x = ("a.y + dy", "a.x + dx") if again is None else (_mirror("a.y + dy", n, again), _mirror("a.x + dx", n, again))
    return f"""near as (select a.img, a.y, a.x, a.v, dy, dx, b.v nv from {source} a cross join range({-radius}, {radius + 1}) p(dy) cross join range({-radius}, {radius + 1}) q(dx)
join {source} b on b.img = a.img and b.y = {y} and b.x = {x})"""


def _gauss(radius: int, sigma: float) -> str:
    g = f"exp(-(dy * dy + dx * dx) / (2 * {sigma}::double * {sigma}::double))"
    return f"ker as (select dy, dx, {g} / sum({g}) over () w from range({-radius}, {radius + 1}) p(dy), range({-radius}, {radius + 1}) q(dx))"


_SSD = "r.n + c.n - 2 * list_inner_product(r.p, c.p)"
_SAD = "list_sum([abs(z[1] - z[2]) for z in list_zip(r.p, c.p)])"


def _pairs(source: str, n: int | str, patch: int, stride: int, radius: int, measure: str = _SSD, frames: int = 0) -> str:
    """dist: distances of reference patches to the patches around them."""
    corners = _axis(n - patch + 1 if isinstance(n, int) else f"({n} - {patch - 1})")
    return f"""patches as materialized (select s.img, a.y, b.x, list(cast(s.v as double) order by s.y, s.x) p, cast(sum(s.v * s.v) as double) n from {source} s
join {corners} a(y) on s.y >= a.y and s.y < a.y + {patch} join {corners} b(x) on s.x >= b.x and s.x < b.x + {patch} group by 1, 2, 3),
dist as materialized (select r.img, r.y ref_y, r.x ref_x, c.img t, c.y, c.x, cast({measure} as bigint) dist from patches r join patches c on c.img >= r.img - {frames} and c.img <= r.img + {frames}
and abs(c.y - r.y) <= {radius} and abs(c.x - r.x) <= {radius} where r.y % {stride} = 0 and r.x % {stride} = 0)"""


def _best(k: int, where: str = "true", order: str = "dist, y, x", dist: str = "dist", frame: str = "") -> str:
    return f"""select img, cast(ref_y as int) ref_y, cast(ref_x as int) ref_x, cast(rk as int) rk, {dist} dist{frame}, cast(y as int) y, cast(x as int) x
from (select *, row_number() over (partition by img, ref_y, ref_x order by {order}) rk from dist where {where}) where rk <= {k}"""


_OTHER = "not (y = ref_y and x = ref_x)"
_VIDEO = f"{FRAMES}, {_pairs('frames', 16, 8, 4, 19, frames=1)}, best as ({_best(8, 'not (y = ref_y and x = ref_x and t = img)', 'dist, t, y, x', frame=', t')})"
_POOL = f"""{FRAMES}, {_pairs('frames', 16, 5, 3, 6, frames=1)},
spatial as (select *, row_number() over (partition by img, ref_y, ref_x order by dist, y, x) k from dist where t = img qualify k <= 8),
temporal as (select *, row_number() over (partition by img, ref_y, ref_x order by dist, y, x) k from dist where t = img - 1 and abs(y - ref_y) <= 4 and abs(x - ref_x) <= 4 qualify k <= 3),
every as (select img, ref_y, ref_x, dist, 0 t, y - ref_y dy, x - ref_x dx, k from spatial where {_OTHER} union all select img, ref_y, ref_x, dist, 1, y - ref_y, x - ref_x, k from temporal),
ranked as (select *, row_number() over (partition by img, ref_y, ref_x order by dist, t desc, k) slot from every),
pool as (select img, ref_y, ref_x, s slot, coalesce(t, 0) t, coalesce(dy, 0) dy, coalesce(dx, 0) dx from (select distinct img, ref_y, ref_x from every) cross join range(8) a(s)
left join (select * from ranked where slot < 8) r using (img, ref_y, ref_x) where r.slot = s or r.slot is null and false union all
select distinct img, ref_y, ref_x, 0, 0, 0, 0 from every)"""
_WEIGHTED = "sum(w * nv) / sum(w)"
_STABLE = f"stable as (select img, y, x, {_stable(A, B)} v from normal)"
_BACK = f"least(greatest({A}::double * (v * v / 4 - 0.375 - {B}::double / ({A}::double * {A}::double)), 0), 1)"
_COLORS = """colors as (select *, substr('GBRG', cast(y % 2 * 2 + x % 2 + 1 as int), 1) own, substr('GBRG', cast((y + dy + 2) % 2 * 2 + (x + dx + 2) % 2 + 1 as int), 1) c from near),
rgbs as (select img, y, x, avg(nv) filter (c = 'R' and ((own = 'R' and dy = 0 and dx = 0) or (own <> 'R' and not (dy = 0 and dx = 0)))) r,
avg(nv) filter (c = 'G' and ((own = 'G' and dy = 0 and dx = 0) or (own <> 'G' and (dy = 0 or dx = 0) and not (dy = 0 and dx = 0)))) g,
avg(nv) filter (c = 'B' and ((own = 'B' and dy = 0 and dx = 0) or (own <> 'B' and not (dy = 0 and dx = 0)))) b from colors group by 1, 2, 3)"""


def _curve(v: str) -> str:
    v = f"least(greatest({v}, 0), 1)"
    return f"cast(floor(least(greatest(round(case when {v} <= 0.0031308 then {v} * 12.92::double else pow({v}, 1 / 2.4::double) * 1.055::double - 0.055::double end, 9) * 255, 0), 255)) as int)"


_I0 = "(select sum(pow({x} * {x} / 4.0::double, k) / (factorial(cast(k as int))::double * factorial(cast(k as int))::double)) from range(20) t(k))"
_KAISER = f"line as (select i, {_I0.format(x='(2 * sqrt(1 - pow(2 * i / 7.0::double - 1, 2)))')} / {_I0.format(x='2.0::double')} w from range(8) a(i))"

ORACLE_SQL |= {
    "split_tiles": f"with {RAW} select img, y, x, v, cast(a.s as int) y0, cast(b.s as int) x0 from raw join {_starts(32, 16, 4)} a on y >= a.s and y < a.s + 16 join {_starts(32, 16, 4)} b on x >= b.s and x < b.s + 16",
    "tile_merge": f"with {RAW} select img, y, x, round(avg(v + a.s * 0.5::double + b.s), 6) v from raw join {_starts(32, 16, 4)} a on y >= a.s and y < a.s + 16 join {_starts(32, 16, 4)} b on x >= b.s and x < b.s + 16 group by 1, 2, 3",
    "center_crop": f"with {RAW} select img, y - 6 y, x - 4 x, v from raw where y >= 6 and y < 26 and x >= 4 and x < 28",
    "regex_catalog": f"with {_PATHS} select * from files",
    "clean_noisy_join": f"with {_PATHS} select n.scene, n.iso, n.frame, n.noisy_idx, n.path noisy_path, c.path clean_path from files n join files c on c.is_clean and not n.is_clean and n.scene = c.scene and n.iso = c.iso and n.frame = c.frame",
    "filtered_tasks": f"with {_PATHS} select * from files where iso = 3200 and scene = 'scene1'",
    "first_per_key": f"with {_FIRST} select scene, iso, frame, noisy_idx, event_id, a, b from firsts",
    "params_semi": f"with {_PATHS}, {_FIRST} select f.*, p.a, p.b from files f join firsts p on f.scene = p.scene and f.iso = p.iso and f.frame = p.frame",
    "params_anti": f"with {_PATHS}, {_FIRST} select * from files f where not exists (from firsts p where f.scene = p.scene and f.iso = p.iso and f.frame = p.frame)",
    "ordinal_join": f"""with {_PATHS}, l as (select scene, path, row_number() over (partition by scene order by path) pos from files where not is_clean),
r as (select scene, path, row_number() over (partition by scene order by path) pos from files where is_clean) select l.scene, cast(l.pos as int) pos, l.path left_item, r.path right_item from l left join r on l.scene = r.scene and l.pos = r.pos""",
    "bayer_lookup": """with c as (select lpad(cast(n_nationkey as varchar), 4, '0') || '_001_' || r_name || '_10000_N' id, r_name, n_nationkey k, case r_regionkey % 4 when 0 then 'RGGB' when 1 then 'BGGR' when 2 then 'GRBG' else 'GBRG' end p
from nation join region on n_regionkey = r_regionkey), d as (select *, s ch, substr(p, cast(s + 1 as int), 1) color from c, range(4) a(s))
select id scene_instance_id, r_name camera, cast(ch as int) ch, color, round((k + case color when 'R' then 1 when 'G' then 2 else 3 end) / 1000.0::double, 9) gain,
round(sqrt(greatest((k - case color when 'R' then 3 when 'G' then 2 else 1 end) / 100000.0::double, 0)), 9) sigma, cast(strpos(p, 'G') - 1 as int) first_green from d""",
    "unify_rows": """select event_type as method, cast(event_id % 7 + 1 as int) frame, value psnr,
round(case event_type when 'view' then value + value * 2 when 'click' then value when 'purchase' then value when 'error' then value else 0 end, 9) time_all,
round(case event_type when 'view' then value / 100 when 'click' then value / 50 when 'purchase' then value / 25 else 0 end, 9) a_norm,
round(case event_type when 'view' then value / 1000 when 'click' then value / 500 * (value / 500) when 'purchase' then value / 250 when 'error' then value / 200 else 0 end, 9) sigma_norm from events""",
    "ssim": f"""with {FRAMES}, ab as (select img, y, x, {_N01.format('v')} a, {_N01.format('clean')} b from pairs),
win as (select p.img, p.y, p.x, avg(q.a) ma, avg(q.b) mb, var_samp(q.a) va, var_samp(q.b) vb, covar_samp(q.a, q.b) cov from ab p join ab q on p.img = q.img and abs(p.y - q.y) <= 3 and abs(p.x - q.x) <= 3
where p.y >= 3 and p.y < 13 and p.x >= 3 and p.x < 13 group by 1, 2, 3)
select img, round(avg((2 * ma * mb + 0.0001::double) * (2 * cov + 0.0009::double) / ((ma * ma + mb * mb + 0.0001::double) * (va + vb + 0.0009::double))), 6) ssim from win group by 1""",
    "local_variance": f"""with {RAW}, c as (select r.img, a.s y, b.s x, greatest({A}::double * avg(v) + {B}::double, 1e-12) variance from normal r, range(0, 25, 4) a(s), range(0, 25, 4) b(s) where r.y >= a.s and r.y < a.s + 8 and r.x >= b.s and r.x < b.s + 8 group by 1, 2, 3)
select img, cast(y as int) y, cast(x as int) x, round(variance, 9) variance, round(sqrt(variance) * 2.7::double, 9) "limit" from c""",
    "gaussian_filter": f"with {RAW}, {_near('raw', 32, 3, 1)}, {_gauss(3, 1.0)} select img, y, x, round(sum(w * nv), 6) v from near join ker using (dy, dx) group by 1, 2, 3",
    "guide_blur": f"with {RAW}, {_STABLE}, {_near('stable', 32, 2, 0)}, {_gauss(2, 1.5)} select img, y, x, round(sum(w * nv), 6) v from near join ker using (dy, dx) group by 1, 2, 3",
    "yaroslavsky": f"with {RAW}, {_near('raw', 32, 3, 1)}, t as (select *, exp(-(nv - v) * (nv - v) / 14400.0::double) w from near) select img, y, x, round({_WEIGHTED}, 6) v from t group by 1, 2, 3",
    "bilateral": f"with {RAW}, {_near('raw', 32, 3, 1)}, t as (select *, exp(-(nv - v) * (nv - v) / 14400.0::double) * exp(-(dy * dy + dx * dx) / 9.0::double) w from near) select img, y, x, round({_WEIGHTED}, 6) v from t group by 1, 2, 3",
    "bilateral_vst": f"""with {RAW}, {_STABLE}, {_near('stable', 32, 4, 0)}, t as (select *, exp(-(nv - v) * (nv - v) / 8.0::double) * exp(-(dy * dy + dx * dx) / 162.0::double) w from near where dy * dy + dx * dx <= 16),
f as (select img, y, x, {_WEIGHTED} v from t group by 1, 2, 3) select img, y, x, round({_BACK}, 6) v from f""",
    "demosaic_bilinear": f"with {RAW}, {_near('raw', 32, 1, 0)}, {_COLORS} select img, y, x, round(r, 6) r, round(g, 6) g, round(b, 6) b from rgbs",
    "forward_isp": f"""with {RAW}, {_near('normal', 32, 1, 0)}, {_COLORS}, w as (select img, y, x, least(r * 2.394::double, 1) r, least(g, 1) g, least(b * 1.597::double, 1) b from rgbs)
select img, y, x, {_curve('(r * 1.9712::double - g * 0.7503::double - b * 0.2209::double)')} r, {_curve('(-r * 0.2491::double + g * 1.4727::double - b * 0.2236::double)')} g, {_curve('(r * 0.0172::double - g * 0.4864::double + b * 1.4692::double)')} b from w""",
    "match_mse_topk": f"with {RAW}, {_pairs('raw', 32, 4, 4, 7)} {_best(16, _OTHER, dist='round(dist / 16.0::double, 6)')}",
    "match_sad_topk": f"with {RAW}, {_pairs('raw', 32, 5, 3, 6, _SAD)} {_best(4, _OTHER)}",
    "match_threshold": f"with {RAW}, {_pairs('raw', 32, 4, 4, 10)} {_best(16, 'dist < 3000000', f'{_OTHER}, dist, y, x')}",
    "match_all_topk": f"with {FRAMES}, {_pairs('frames', 16, 5, 6, 16)} {_best(16, 'ref_y = 6 and ref_x = 6')}",
    "match_video_topk": f"with {_VIDEO} select * from best",
    "source_frame_counts": f"with {_VIDEO} select img, ref_y, ref_x, count(*) filter (t < img) \"before\", count(*) filter (t = img) same, count(*) filter (t > img) \"after\" from best group by 1, 2, 3",
    "pool_top7_pad8": f"with {_POOL} select img, cast(ref_y as int) ref_y, cast(ref_x as int) ref_x, cast(slot as int) slot, cast(t as int) t, cast(dy as int) dy, cast(dx as int) dx from pool",
    "temporal_usage_hist": f"with {_POOL}, u as (select img, ref_y, ref_x, cast(sum(t) as bigint) time_used from pool group by 1, 2, 3) select time_used, count(*) \"groups\" from u group by 1",
    "collaborative_mean": f"with {RAW}, {_pairs('raw', 32, 5, 3, 6, _SAD)}, b as ({_best(4, _OTHER)}) select b.img, ref_y, ref_x, round(avg(v), 6) v from b join raw r on r.img = b.img and r.y = b.y + 2 and r.x = b.x + 2 group by 1, 2, 3",
    "group_weight": f"with {_DCT} select y, round(1.0::double / greatest(count(*) filter (v <> 0), 1), 6) w from kept group by 1",
    "dct_distance": f"with {_DCT} select a.y, round(sum((a.v - b.v) * (a.v - b.v)), 5) dist from kept a join kept b on b.y = a.y + 1 and a.i = b.i and a.j = b.j group by 1",
    "dct3d_group": f"""with {_DCT}, five as (select k, n, case when k = 0 then sqrt(1 / 5.0::double) else sqrt(2 / 5.0::double) end * cos(pi() * (2 * n + 1) * k / 10.0::double) c from range(5) a(k), range(5) b(n))
select cast(y // 5 as int) g, i, j, cast(k as int) k, round(sum(c * v), 5) v from spectrum join five on n = y % 5 group by 1, 2, 3, 4""",
    "haar8_group": f"""with {EMB}, p as (select y, cast(x // 8 as int) i, x % 8 j, v from e),
haar as (select k, n, case when k = 0 then sqrt(1 / 8.0::double) else sqrt(pow(2, l) / 8) * case when n // (8 // cast(pow(2, l) as int)) <> k - cast(pow(2, l) as int) then 0 when n % (8 // cast(pow(2, l) as int)) < 4 // cast(pow(2, l) as int) then 1 else -1 end end c
from (select k, case when k = 0 then 0 else cast(floor(log2(k)) as int) end l from range(8) a(k)), range(8) b(n))
select y, i, cast(k as int) k, round(sum(c * v), 5) v from p join haar on n = j group by 1, 2, 3""",
    "haar5_round_trip": f"with {EMB} select cast(y // 5 as int) g, x, cast(y % 5 as int) k, round(v, 5) v from e",
    "scatter_aggregate": f"with {RAW} select img, y, x, round(sum(v / (1.0::double + a.s + 2 * b.s)) / sum(1 / (1.0::double + a.s + 2 * b.s)), 6) v from raw join range(0, 25, 4) a(s) on y >= a.s and y < a.s + 8 join range(0, 25, 4) b(s) on x >= b.s and x < b.s + 8 group by 1, 2, 3",
    "coverage_fallback": f"with {RAW} select img, y, x, round(v + case when y % 12 < 8 and x % 12 < 8 then 0.5::double else 0 end, 6) v from raw",
    "nlm": f"""with {RAW}, {_near('raw', 32, 2, 0)}, {_gauss(2, 1.0)}, d as (select a.img, a.y, a.x, b.v nv, cast(sum(w * (p.nv - q.nv) * (p.nv - q.nv)) as double) d from raw a join raw b on a.img = b.img and b.y - a.y between -5 and 4 and b.x - a.x between -5 and 4
cross join ker join near p on p.img = a.img and p.y = a.y and p.x = a.x and p.dy = ker.dy and p.dx = ker.dx join near q on q.img = b.img and q.y = b.y and q.x = b.x and q.dy = ker.dy and q.dx = ker.dx group by a.img, a.y, a.x, b.y, b.x, b.v),
t as (select *, exp(-d / 22500.0::double) w from d) select img, y, x, round({_WEIGHTED}, 6) v from t group by 1, 2, 3""",
}
ORACLE_SQL["guide_blur_separable"] = ORACLE_SQL["guide_blur"]
for _name, _again in (("pad_reflect", 1), ("pad_reflect101", 0)):
    ORACLE_SQL[_name] = f"with {FRAMES} select img, cast(a.s as int) y, cast(b.s as int) x, v from range(-3, 19) a(s), range(-3, 19) b(s), frames where frames.y = {_mirror('a.s', 16, _again)} and frames.x = {_mirror('b.s', 16, _again)}"


# colors, margins, result rows, calibration and eight-bit filters



def _colors(y: str, cr: str, cb: str) -> str:
    parts = {"r": f"{y} + ({cr} - 128.0::double) * 1.403::double", "g": f"{y} - ({cr} - 128.0::double) * 0.714::double - ({cb} - 128.0::double) * 0.344::double", "b": f"{y} + ({cb} - 128.0::double) * 1.773::double"}
    return ", ".join(f"cast(floor(least(greatest(round({v}, 9), 0), 255) + 0.5) as int) {n}" for n, v in parts.items())


_LUMA = f"parts as (select 0 img, y, x, {_u8(f'{_Y} + 0.5::double')} v, {_u8(f'(r - {_Y}) * 0.713::double + 128.5::double')} cr, {_u8(f'(b - {_Y}) * 0.564::double + 128.5::double')} cb from rgb)"
_EIGHT = f"{RAW}, eight as (select img, y, x, v % 256 v from raw), {_near('eight', 32, 3, 1)}"
_DIFF = "exp(-(nv - v) * (nv - v) / 14400.0::double)"
_TIMED = "timed as (select user_id, cast(event_id % 7 + 1 as int) frame, event_id, value \"seconds\" from events)"
_U8V = "cast(floor(least(greatest(round(v, 6), 0), 255)) as int) v"
_E8 = "cast(floor(least(greatest({} * 255.0::double / 4095.0::double, 0), 255) + 0.5) as int)"
_STACKS = f"""scells as (select s scene, i img, y, x from range(4) d(s), range(1, 8) c(i), range(16) a(y), range(16) b(x)),
ssums as (select cast(l_suppkey % 4 as bigint) scene, cast(l_linenumber as bigint) img, l_orderkey % 16 y, l_partkey % 16 x, cast(sum(l_quantity) as bigint) q from lineitem group by 1, 2, 3, 4),
stacks as (select cast(scene as int) scene, img, y, x, cast({_SQ} as int) v from scells left join ssums using (scene, img, y, x))"""

ORACLE_SQL |= {
    "ycrcb_inverse": f"with {FRAMES} select y, x, {_colors('r', 'g', 'b')} from rgb",
    "recombine_color": f"with {FRAMES}, {_LUMA}, {_near('parts', 16, 1, 0)}, f as (select y, x, round(avg(nv), 6) v from near group by 1, 2) select y, x, {_colors('f.v', 'cr', 'cb')} from f join parts using (y, x)",
    "pad_edge": f"with {FRAMES} select img, cast(a.s as int) y, cast(b.s as int) x, v from range(-3, 19) a(s), range(-3, 19) b(s), frames where frames.y = least(greatest(a.s, 0), 15) and frames.x = least(greatest(b.s, 0), 15)",
    "pad_constant": f"with {FRAMES}, images as (select distinct img from frames) select i.img, cast(a.s as int) y, cast(b.s as int) x, coalesce(v, 0) v from range(-3, 19) a(s), range(-3, 19) b(s), images i left join frames f on f.img = i.img and f.y = a.s and f.x = b.s",
    "extension_filter": f"""with {_PATHS}, mixed as (select case length(path) % 3 when 0 then left(path, length(path) - 4) || 'TIFF' when 1 then left(path, length(path) - 4) || 'png' else path end path from paths)
select path from mixed where path ilike '%.tif' or path ilike '%.tiff'""",
    "amortized_time": f"with {_TIMED} select user_id, count(distinct frame) frames, round(sum(\"seconds\"), 4) total, round(sum(\"seconds\") / count(distinct frame), 4) per_frame from timed group by 1",
    "elapsed_time": f"with {_TIMED} select *, round(sum(\"seconds\") over w, 9) elapsed, round(avg(\"seconds\") over w, 9) mean_step from timed window w as (partition by user_id order by event_id rows unbounded preceding)",
    "result_table": f"with {RESULTS} select method, iso, frame, round(avg(psnr), 9) psnr, null::double ssim from results group by 1, 2, 3 order by 1, 2, 3",
    "finite_distances": "select event_id, value dist from events where event_id % 10 > 1",
    "psnr_u8": f"with {FRAMES}, m as (select img, avg(pow({_E8.format('v')} - {_E8.format('clean')}, 2)) m from pairs group by 1) select img, round(case when m > 0 then 10 * log10(255.0::double * 255 / m) else 'inf'::double end, 6) psnr from m",
    "psnr_equal": f"with {FRAMES} select distinct img, 'inf'::double psnr from frames",
    "calibration": f"""with {_STACKS}, st as (select scene, y, x, avg(v - 240.0::double) m, var_samp(v - 240.0::double) var from stacks group by 1, 2, 3),
q as (select scene, greatest(quantile_cont(m, 0.05), 0) lo, quantile_cont(m, 0.95) hi from st group by 1),
fit as (select scene, count(*) n, regr_slope(var, m) a, regr_intercept(var, m) b from st join q using (scene) where m between lo and hi and var >= 0 group by 1),
e as (select scene, img, avg(pow(v - floor(m + 240), 2)) e from stacks join st using (scene, y, x) group by 1, 2),
p as (select scene, avg(case when e > 0 then 10 * log10(4095.0::double * 4095 / e) else 'inf'::double end) psnr from e group by 1)
select scene, n, round(case when n >= 100 then a end, 4) a, round(case when n >= 100 then b end, 4) b, round(psnr, 4) psnr from fit join p using (scene)""",
    "gaussian_u8": f"with {_EIGHT}, {_gauss(3, 1.0)}, f as (select img, y, x, sum(w * nv) v from near join ker using (dy, dx) group by 1, 2, 3) select img, y, x, {_U8V} from f",
    "yaroslavsky_u8": f"with {_EIGHT}, t as (select *, {_DIFF} w from near), f as (select img, y, x, {_WEIGHTED} v from t group by 1, 2, 3) select img, y, x, {_U8V} from f",
    "bilateral_u8": f"with {_EIGHT}, t as (select *, {_DIFF} * exp(-(dy * dy + dx * dx) / 9.0::double) w from near), f as (select img, y, x, {_WEIGHTED} v from t group by 1, 2, 3) select img, y, x, {_U8V} from f",
    "temporal_usage_share": f"with h as ({ORACLE_SQL['temporal_usage_hist']}) select time_used, \"groups\", round(100.0::double * \"groups\" / sum(\"groups\") over (), 6) percent, round(sum(time_used * \"groups\") over () / (sum(\"groups\") over ())::double, 6) mean from h",
    "match_joint_topk": f"""with {RAW}, {PACKED}, patches as materialized (select s.img, a.y, b.x, list(cast(s.v as double) order by s.ch, s.y, s.x) p, cast(sum(s.v * s.v) as double) n from packed s
join range(9) a(y) on s.y >= a.y and s.y < a.y + 8 join range(9) b(x) on s.x >= b.x and s.x < b.x + 8 group by 1, 2, 3),
dist as (select r.img, r.y ref_y, r.x ref_x, c.y, c.x, cast({_SSD} as bigint) dist from patches r join patches c on c.img = r.img where r.y % 4 = 0 and r.x % 4 = 0) {_best(16, _OTHER)}""",
    "nlm_vst": f"""with {RAW}, {_STABLE}, wide as (select img, a.s y, b.s x, v from range(-8, 40) a(s), range(-8, 40) b(s), stable where stable.y = {_mirror('a.s', 32, 0)} and stable.x = {_mirror('b.s', 32, 0)}),
patches as materialized (select c.img, c.y, c.x, c.v, list(p.v order by p.y, p.x) p, sum(p.v * p.v) n from wide c join wide p on c.img = p.img and abs(p.y - c.y) <= 2 and abs(p.x - c.x) <= 2 where c.y between -6 and 37 and c.x between -6 and 37 group by 1, 2, 3, 4),
t as (select r.img, r.y, r.x, c.v nv, greatest(({_SSD}) / 25 - 2, 0) / 1.3225::double d from patches r join patches c on c.img = r.img and abs(c.y - r.y) <= 6 and abs(c.x - r.x) <= 6 where r.y between 0 and 31 and r.x between 0 and 31),
f as (select img, y, x, sum(exp(-d) * nv) / sum(exp(-d)) v from t where d <= 5 group by 1, 2, 3) select img, cast(y as int) y, cast(x as int) x, round({_BACK}, 6) v from f""",
}


# collaborative filtering, from the search to the aggregation


def _bm3d(noisy: str, raw: str, side: int | str, k: int, *, channels: int = 1, frames: int = 0, noise: bool = False, radius: int = 19) -> str:
    """filtered: `noisy` (img, y, x, v) after one stage of collaborative filtering, with groups found on a blur of `raw`.

    Channels of an image are images of their own, numbered img * channels + ch. Patches are 8 x 8, references 4 apart.
    """
    c, last, ref = channels, side - 7 if isinstance(side, int) else f"({side} - 7)", "img, ref_y, ref_x"
    limit, variance = ("sqrt(variance) * 2.7::double", "variance") if noise else ("2.7::double", "1.0::double")
    return f"""kern as (select * from (values (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) t(d, kw)),
{_wide(raw, side, 2, 0)},
guide as materialized (select m.img, m.y, m.x, cast(sum(p.kw * q.kw * b.v) as bigint) v from {raw} m cross join kern p cross join kern q
join wide b on b.img = m.img and b.y = m.y + p.d and b.x = m.x + q.d group by 1, 2, 3),
patches as materialized (select s.img // {c} img, a.y, b.x, list(cast(s.v as double) order by s.img % {c}, s.y, s.x) p, cast(sum(s.v * s.v) as double) n from guide s
join {_axis(last)} a(y) on s.y >= a.y and s.y < a.y + 8 join {_axis(last)} b(x) on s.x >= b.x and s.x < b.x + 8 group by 1, 2, 3),
dist as materialized (select r.img, r.y ref_y, r.x ref_x, c.img t, c.y, c.x, cast({_SSD} as bigint) dist from patches r join patches c on abs(c.img - r.img) <= {frames}
and abs(c.y - r.y) <= {radius} and abs(c.x - r.x) <= {radius} where r.y % 4 = 0 and r.x % 4 = 0),
nearest as (select *, row_number() over (partition by {ref} order by dist, t, y, x) rk from dist where not (y = ref_y and x = ref_x and t = img) qualify rk <= {k}),
local as (select s.img // {c} img, a.y ref_y, b.x ref_x, greatest({A}::double * avg(s.v) + {B}::double, 1e-12) variance from {noisy} s
join {_axis(last, 4)} a(y) on s.y >= a.y and s.y < a.y + 8 join {_axis(last, 4)} b(x) on s.x >= b.x and s.x < b.x + 8 group by 1, 2, 3),
sized as (select {ref}, count(*) + 1 size, any_value(variance) variance from nearest join local using ({ref}) group by {ref}),
members as materialized (select {ref}, rk m, t, y, x from nearest union all select {ref}, 0, img, ref_y, ref_x from sized),
basis as materialized (select n, k, i, case when k = 0 then sqrt(1.0::double / n) else sqrt(2.0::double / n) end * cos(pi() * (2 * i + 1) * k / (2.0::double * n)) f
from range(2, {max(k, 8) + 2}) s(n), range({max(k, 8) + 1}) a(k), range({max(k, 8) + 1}) b(i) where k < n and i < n),
pieces as (select u.t, u.y, u.x, s.img % {c} ch, s.y - u.y i, s.x - u.x j, s.v from (select distinct t, y, x from members) u
join {noisy} s on s.img // {c} = u.t and s.y >= u.y and s.y < u.y + 8 and s.x >= u.x and s.x < u.x + 8),
tall as (select t, y, x, ch, b.k i, j, sum(f * v) v from pieces e join basis b on b.n = 8 and b.i = e.i group by t, y, x, ch, b.k, j),
flat as materialized (select t, y, x, ch, e.i, b.k j, sum(f * v) v from tall e join basis b on b.n = 8 and b.i = e.j group by t, y, x, ch, e.i, b.k),
spectrum as (select {ref}, size, variance, ch, b.k k, e.i, e.j, sum(f * v) v from members join sized using ({ref}) join flat e using (t, y, x) join basis b on b.n = size and b.i = m group by {ref}, size, variance, ch, b.k, e.i, e.j),
kept as materialized (select * exclude (v), case when round(abs(v), 9) < {limit} then 0 else v end v from spectrum),
weights as (select {ref}, avg(w) w from (select {ref}, ch, 1.0::double / (greatest(count(*) filter (v <> 0), 1) * any_value({variance})) w from kept group by {ref}, ch) group by {ref}),
back as (select {ref}, ch, b.i m, e.i, e.j, sum(f * v) v from kept e join basis b on b.n = size and b.k = e.k group by {ref}, ch, b.i, e.i, e.j),
backi as (select {ref}, ch, m, b.i i, e.j, sum(f * v) v from back e join basis b on b.n = 8 and b.k = e.i group by {ref}, ch, m, b.i, e.j),
backj as (select {ref}, ch, m, e.i, b.i j, sum(f * v) v from backi e join basis b on b.n = 8 and b.k = e.j group by {ref}, ch, m, e.i, b.i),
summed as (select p.t * {c} + ch img, p.y + i y, p.x + j x, sum(w * v) / sum(w) v from backj join members p using ({ref}, m) join weights using ({ref}) group by 1, 2, 3),
filtered as (select s.img, s.y, s.x, coalesce(o.v, s.v) v from {noisy} s left join summed o on o.img = s.img and o.y = s.y and o.x = s.x)"""


_FRAMES_STABLE = f"fnormal as (select img, y, x, {_N01.format('v')} v from frames), fstable as (select img, y, x, {_stable(A, B)} v from fnormal)"
_CHANNELS = f"""{PACKED}, praw as (select cast(img * 4 + ch as int) img, y, x, v from packed), pnormal as (select img, y, x, {_N01.format('v')} v from praw),
pstable as (select img, y, x, {_stable(A, B)} v from pnormal)"""
_ASYM = f"least(greatest({A}::double * (v * v / 4 - 0.125 - {B}::double / ({A}::double * {A}::double)), 0), 1)"

ORACLE_SQL |= {
    "bm3d_vst": f"with {RAW}, {_STABLE}, {_bm3d('stable', 'raw', 32, 8)} select img, y, x, round({_BACK}, 6) v from filtered",
    "bm3d_novst": f"with {RAW}, {_bm3d('normal', 'raw', 32, 8, noise=True)} select img, y, x, round(least(greatest(v, 0), 1), 6) v from filtered",
    "vbm3d_vst": f"with {FRAMES}, {_FRAMES_STABLE}, {_bm3d('fstable', 'frames', 16, 8, frames=1)} select img, y, x, round({_BACK}, 6) v from filtered",
    "bm3d_packed4": f"""with {RAW}, {_CHANNELS}, {_bm3d('pstable', 'praw', 16, 16, channels=4)}
select cast(img // 4 as int) img, cast(y * 2 + img % 4 // 2 as int) y, cast(x * 2 + img % 2 as int) x, round({_ASYM}, 6) v from filtered""",
}


# rasters that grow with the tables, and the frame before

_SIDE = "(select n from side)"
_GROWN = f"""side as (select min(n) n from (select 32 * cast(pow(2, e) as bigint) n from range(24) t(e)) where 10 * n * n >= (select count(*) from lineitem)),
gcells as (select a.y, b.x from {_axis(_SIDE)} a(y), {_axis(_SIDE)} b(x)),
gsums as (select l_orderkey % n y, (l_partkey * 7 + l_suppkey) % n x, cast(sum(l_quantity) * 9 as bigint) q from lineitem, side group by 1, 2),
raw as materialized (select 0 img, cast(y as int) y, cast(x as int) x, cast({_SQ} as int) v from gcells left join gsums using (y, x)),
normal as (select img, y, x, {_N01.format('v')} v from raw)"""
_CLIPS = f"""ccells as (select s seq, i * (i + s) frame, y, x from range(3) d(s), range(1, 8) c(i), range(16) a(y), range(16) b(x)),
csums as (select l_suppkey % 3 seq, l_linenumber * (l_linenumber + l_suppkey % 3) frame, l_orderkey % 16 y, l_partkey % 16 x, cast(sum(l_quantity) as bigint) q from lineitem group by 1, 2, 3, 4),
clips as (select cast(seq as int) seq, cast(frame as int) frame, cast(y as int) y, cast(x as int) x, cast({_SQ} as int) v from ccells left join csums using (seq, frame, y, x))"""

ORACLE_SQL |= {
    "match_grown": f"with {_GROWN}, {_pairs('raw', _SIDE, 8, 4, 19)} {_best(8, _OTHER)}",
    "bm3d_grown": f"with {_GROWN}, {_STABLE}, {_bm3d('stable', 'raw', _SIDE, 8)} select img, y, x, round({_BACK}, 6) v from filtered",
    "yaroslavsky_grown": f"with {_GROWN}, {_near_wide('raw', _SIDE, 3, 1)}, t as (select *, exp(-(nv - v) * (nv - v) / 102400.0::double) w from near) select img, y, x, round({_WEIGHTED}, 6) v from t group by 1, 2, 3",
    "temporal_matches": f"""with {_CLIPS}, prior as (select seq, frame, lag(frame) over (partition by seq order by frame) prior from (select distinct seq, frame from clips)),
patches as materialized (select s.seq, s.frame, a.y, b.x, list(cast(s.v as double) order by s.y, s.x) p, cast(sum(s.v * s.v) as double) n from clips s
join range(12) a(y) on s.y >= a.y and s.y < a.y + 5 join range(12) b(x) on s.x >= b.x and s.x < b.x + 5 group by 1, 2, 3, 4),
dist as (select r.seq, r.frame, c.frame prior, r.y ref_y, r.x ref_x, c.y, c.x, cast({_SSD} as bigint) dist from patches r join prior q on q.seq = r.seq and q.frame = r.frame
join patches c on c.seq = r.seq and c.frame = q.prior and abs(c.y - r.y) <= 4 and abs(c.x - r.x) <= 4 where r.y % 3 = 0 and r.x % 3 = 0)
select seq, frame, prior "before", cast(ref_y as int) ref_y, cast(ref_x as int) ref_x, cast(rk as int) rk, dist, cast(y as int) y, cast(x as int) x
from (select *, row_number() over (partition by seq, frame, ref_y, ref_x order by dist, y, x) rk from dist) where rk <= 3""",
}


# one random stream, and a sweep

_STREAM = "list_reduce(list_prepend({seed}::bigint, range({bits})), lambda x, i: x * case when (({at}) >> i) & 1 = 1 then {powers}[i + 1] else 1 end % {m})"


def _uniform(at: str, seed: int) -> str:
    one, two = (_STREAM.format(seed=x, bits=streams.BITS, at=at, powers=f"p{k}", m=m) for k, (x, (m, _)) in enumerate(zip(streams.seeds(seed), streams.GENERATORS, strict=True)))
    top = streams.GENERATORS[0][0]
    return f"((({one} - {two} - 1) % {top - 1} + {top - 1}) % {top - 1} + 1) / {top}.0::double"


def _sweep() -> str:
    each = (
        f"select * from (with {FRAMES}, {_FRAMES_STABLE}, {_bm3d('fstable', 'frames', 16, 8).replace('2.7::double', f'{x}::double')}, f as (select img, y, x, {_BACK} v from filtered) "
        f"select {x}::double strength, p.img, avg(pow({_N01.format('p.v')} - {_N01.format('clean')}, 2)) n, avg(pow(f.v - {_N01.format('clean')}, 2)) m from pairs p join f using (img, y, x) group by p.img)"
        for x in (1.5, 2.7, 4.0)
    )
    return f"select img, strength, round(10 * log10(1 / n), 6) psnr_noisy, round(10 * log10(1 / m), 6) psnr from ({' union all '.join(each)})"


ORACLE_SQL |= {
    "strength_sweep": _sweep(),
    "noise_stream_u8": f"""with {_CLIPS}, files as (select 'seq' || seq || '/frame' || frame "name", y, x, v % 256 v from clips), sizes as (select "name", count(*) n from files group by 1),
starts as (select "name", coalesce(sum(n) over (order by "name" rows between unbounded preceding and 1 preceding), 0) s from sizes), powers as (select {', '.join(f'{streams.powers(m, a)}::bigint[] p{k}' for k, (m, a) in enumerate(streams.GENERATORS))}),
places as (select "name", y, x, v, cast((s + y * 16 + x) * 2 as bigint) u from files join starts using ("name")),
drawn as (select *, {_uniform('u', 123456)} a, {_uniform('u + 1', 123456)} b from places, powers)
select "name", y, x, cast(floor(least(greatest(round(v + sqrt(-2 * ln(a)) * cos(b * 2 * pi()) * 15, 9), 0), 255)) as int) v from drawn""",
}
ORACLE_SQL["group_dump"] = f"""with {_VIDEO}, first as (select distinct img, ref_y, ref_x from best order by 1, 2, 3 limit 30),
members as (select img, ref_y, ref_x, rk, t, y, x from best join first using (img, ref_y, ref_x) union all select img, ref_y, ref_x, 0, img, ref_y, ref_x from first)
select m.img, m.ref_y, m.ref_x, cast(m.rk as int) "member", m.t, m.y, m.x, string_agg(cast(f.v as varchar), ',' order by f.y, f.x) patch from members m join frames f on f.img = m.t and f.y >= m.y and f.y < m.y + 8 and f.x >= m.x and f.x < m.x + 8
group by 1, 2, 3, 4, 5, 6, 7"""


# grids over rasters that grow with the tables


def _tiles_grown(block: tuple[int, int], overlap: int) -> str:
    starts = [f"(select distinct least(s, greatest(n - {b}, 0)) s from (select unnest(range(0, cast({_SIDE} as bigint), {b - overlap})) s), side)" for b in block]
    return f"""with {_GROWN} select cast(a.s as int) y0, cast(least(a.s + {block[0]}, n) as int) y1, cast(b.s as int) x0, cast(least(b.s + {block[1]}, n) as int) x1 from {starts[0]} a, {starts[1]} b, side"""


def _refs_grown(patch: int, stride: int) -> str:
    axis = _axis(f"({_SIDE} - {patch - 1})", stride)
    return f"with {_GROWN} select cast(y as int) ref_y, cast(x as int) ref_x from {axis} a(y), {axis} b(x)"


ORACLE_SQL |= {
    "tile_grid": _tiles_grown((27, 27), 8),
    "tile_rect": _tiles_grown((16, 30), 7),
    "tile_quadrants": f"""with {_GROWN}, ends as (select cast(0 as int) a, cast(n // 2 + 9 as int) b from side union all select cast(n // 2 - 9 as int), cast(n as int) from side)
select t.a y0, t.b y1, u.a x0, u.b x1 from ends t, ends u""",
    "ref_grid": _refs_grown(8, 4),
    "limit_refs": f"{_refs_grown(8, 3)} order by 1, 2 limit 30",
    "param_grid": f"""with {PARAMS}, images as (select distinct scene, iso from params)
select scene, iso, s sigma, k, p patch, t step from images, (values (10), (20), (30)) a(s), (values (8), (16)) b(k), (values (5), (7), (9)) c(p), (values (1), (2)) d(t)""",
    "kaiser_window": f"with {EMB}, {_KAISER} select y, cast(a.i as int) i, cast(b.i as int) j, round(v * a.w * b.w, 6) v from e join line a on a.i = x // 8 join line b on b.i = x % 8",
}
