"""Registered queries and their SQL: keys begin with the ids of the operators they exercise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polyview.functions.order import medians, numbered, numbered_within
from polyview.functions.staging import stage_table
from polyview.operators import camera as C
from polyview.operators import evaluation as E
from polyview.operators import identity as I
from polyview.operators import maintenance as M
from polyview.operators import pose as P
from polyview.operators import retrieval as R
from polyview.operators import routing as T
from polyview.plans import fixtures as X
from polyview.plans.fixtures import ctes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _pooled(s, d, mode="softmax"):
    return R.pooled_scores(X.views(s, d), X.texts(s, d), mode)


def _scored(s, d, mode="softmax"):
    return R.robust_z(_pooled(s, d, mode))


_RANKED = "SELECT text_id, row_id, rank, round(score, 6) AS score, round(z, 4) AS z FROM scored WHERE rank <= 10"
_BASE = ctes("views", "texts", "sims", "soft", "z")


@add("p03_pool_softmax_query", f"{_BASE} {_RANKED}")
def _(s, d):
    """Every text, softmax pooled, robust z, top 10."""
    return R.rank(_scored(s, d)).select("text_id", "row_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), F.round("z", 4).alias("z"))


for _mode, _agg in (("mean", "avg"), ("max", "max")):
    def _f(s, d, mode=_mode):
        return _pooled(s, d, mode).select("row_id", "text_id", F.round("score", 6).alias("score"))

    add(f"p0{1 if _mode == 'mean' else 2}_pool_{_mode}", f"{ctes('views', 'texts', 'sims')} SELECT row_id, text_id, round({_agg}(sim), 6) AS score FROM sims GROUP BY ALL")(_f)


@add("a06_a07_median_mad", f"{ctes('views', 'texts', 'sims', 'soft')} SELECT p.text_id, round(any_value(m), 6) AS mid, round(median(abs(score - m)) * 1.4826, 6) AS spread FROM pooled p JOIN (SELECT text_id, median(score) AS m FROM pooled GROUP BY 1) q ON p.text_id = q.text_id GROUP BY 1")
def _(s, d):
    p = stage_table(_pooled(s, d), "pooled")
    mid = medians(p, "text_id", "score")
    spread = medians(p.join(mid, "text_id").withColumn("off", F.abs(F.col("score") - F.col("mid"))), "text_id", "off").select("text_id", F.round(F.col("mid") * 1.4826, 6).alias("spread"))
    return mid.join(spread, "text_id").select("text_id", F.round("mid", 6).alias("mid"), "spread")


@add("w03_verdict", f"{_BASE} SELECT text_id, row_id AS best, round(z, 4) AS best_z, z < 2 AS weak FROM scored WHERE rank = 1")
def _(s, d):
    return R.verdict(_scored(s, d)).select("text_id", "best", F.round("best_z", 4).alias("best_z"), "weak")


@add("f05_l02_min_score_cap", f"{_BASE}, h AS (SELECT text_id, count(*) AS n FROM scored WHERE score >= 0.1 GROUP BY 1) SELECT s.text_id, row_id, n > 5 AS truncated FROM scored s JOIN h ON s.text_id = h.text_id WHERE score >= 0.1 AND rank <= 5")
def _(s, d):
    """The floor takes the place of top; cap cuts after it and says whether it cut."""
    hits = R.rank(_scored(s, d), min_score=0.1)
    n = hits.groupBy("text_id").agg(F.count("*").alias("n"))
    return hits.filter("rank <= 5").join(n, "text_id").select("text_id", "row_id", (F.col("n") > 5).alias("truncated"))


@add("j05_j06_l03_similar", f"{ctes('views')}, o AS (SELECT a.row_id, b.view AS own, list_dot_product(a.e, b.e) AS sim FROM views a JOIN views b ON b.row_id = 3 AND a.row_id <> 3), m1 AS (SELECT *, max(sim) OVER (PARTITION BY row_id, own) AS m FROM o), p1 AS (SELECT row_id, own, sum(exp(50 * (sim - m)) * sim) / sum(exp(50 * (sim - m))) AS sim FROM m1 GROUP BY ALL), m2 AS (SELECT *, max(sim) OVER (PARTITION BY row_id) AS m FROM p1), p2 AS (SELECT row_id, sum(exp(50 * (sim - m)) * sim) / sum(exp(50 * (sim - m))) AS score FROM m2 GROUP BY 1), md AS (SELECT median(score) AS m FROM p2), sd AS (SELECT median(abs(score - m)) * 1.4826 + 1e-9 AS s FROM p2, md) SELECT row_id, row_number() OVER (ORDER BY score DESC, row_id) AS rank, round(score, 6) AS score, round((score - m) / s, 4) AS z FROM p2, md, sd QUALIFY rank <= 10")
def _(s, d):
    """Candidate views first, then the target's own; self excluded before z."""
    return R.similar(X.views(s, d), 3).select("row_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), F.round("z", 4).alias("z"))


@add("f03_scoped_query", f"{ctes('views', 'texts', 'sims', 'models', 'soft')}, pk AS (SELECT p.* FROM pooled p JOIN models m ON p.row_id = m.row_id WHERE m.rel = 'kit1' OR starts_with(m.rel, 'kit1/')), md AS (SELECT text_id, median(score) AS m FROM pk GROUP BY 1), sd AS (SELECT p.text_id, median(abs(score - m)) * 1.4826 + 1e-9 AS s FROM pk p JOIN md ON p.text_id = md.text_id GROUP BY 1) SELECT p.text_id, row_id, round((score - m) / s, 4) AS z FROM pk p JOIN md ON p.text_id = md.text_id JOIN sd ON p.text_id = sd.text_id QUALIFY row_number() OVER (PARTITION BY p.text_id ORDER BY score DESC, row_id) <= 3")
def _(s, d):
    """The scope is cut before scoring, so z sees the scoped population."""
    inside = X.models(s, d).filter(R.in_scope(F.col("rel"), "kit1")).select("row_id")
    scores = R.pooled_scores(X.views(s, d).join(inside, "row_id", "left_semi"), X.texts(s, d))
    return R.rank(R.robust_z(scores), top=3).select("text_id", "row_id", F.round("z", 4).alias("z"))


@add("a10_scope_status", f"{ctes('views', 'models')} SELECT path, count_if(indexed) AS n_indexed, count(*) AS n_scanned, CASE WHEN count_if(indexed) = 0 THEN 'unindexed' WHEN count_if(indexed) >= count(*) THEN 'indexed' ELSE 'partial' END AS status FROM models m JOIN (SELECT unnest(['kit1', 'kit2', 'kit3/m3.stl', 'kit1/m100100.stl']) AS path) p ON m.rel = path OR starts_with(m.rel, path || '/') GROUP BY 1")
def _(s, d):
    return R.scope_summary(X.models(s, d), ["kit1", "kit2", "kit3/m3.stl", "kit1/m100100.stl"]).filter("n_scanned > 0")


@add("f04_scope_codes", "SELECT page_id, CASE WHEN contains(url, '#') THEN 422 WHEN NOT (starts_with(url, 'https://')) THEN 400 WHEN page_id % 3 = 0 THEN 404 ELSE 200 END::INT AS code FROM pages")
def _(s, d):
    path = F.replace(F.replace("url", F.lit("#"), F.lit("!/")), F.lit("https://"), F.lit("root/"))
    return X.table(s, d, "pages").select("page_id", R.scope_code(path, F.lit("root"), F.col("page_id") % 3 != 0).alias("code"))


@add("f06_find", f"{ctes('views', 'models')}, h AS (SELECT rel FROM models WHERE contains(lower(rel), 'm1')) SELECT rel, (SELECT count(*) FROM h) AS total FROM h ORDER BY rel LIMIT 20")
def _(s, d):
    return R.find(X.models(s, d), "M1").select("rel", "total")


@add("w04_top3", f"{_BASE}, r AS (SELECT row_id, text_id, round(score, 4) AS score, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, text_id) AS n FROM pooled) SELECT row_id, max(CASE n WHEN 1 THEN text_id END) AS c1, max(CASE n WHEN 1 THEN score END) AS s1, max(CASE n WHEN 2 THEN text_id END) AS c2, max(CASE n WHEN 3 THEN text_id END) AS c3 FROM r WHERE n <= 3 GROUP BY 1")
def _(s, d):
    """Three best categories of each model, smaller id on ties."""
    n = F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("score"), "text_id"))
    r = _pooled(s, d).withColumn("n", n).filter("n <= 3")
    pick = lambda k, c: F.max(F.when(F.col("n") == k, c))
    return r.groupBy("row_id").agg(pick(1, F.col("text_id")).alias("c1"), pick(1, F.round("score", 4)).alias("s1"), pick(2, F.col("text_id")).alias("c2"), pick(3, F.col("text_id")).alias("c3"))


@add("a08_w05_distribution", f"{_BASE}, b AS (SELECT row_id, text_id, score FROM pooled QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY score DESC, text_id) = 1), c AS (SELECT text_id, count(*) AS n, first(row_id ORDER BY score DESC, row_id) AS best FROM b GROUP BY 1) SELECT t.text_id, coalesce(n, 0) AS n, best FROM texts t LEFT JOIN c ON t.text_id = c.text_id")
def _(s, d):
    """Members of each category, zeros included, and its best one."""
    n = F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("score"), "text_id"))
    best = _pooled(s, d).withColumn("n", n).filter("n = 1")
    c = best.groupBy("text_id").agg(F.count("*").alias("n"), F.max(F.struct("score", (-F.col("row_id")).alias("r"))).alias("b"))
    return X.texts(s, d).select("text_id").join(c, "text_id", "left").select("text_id", F.coalesce("n", F.lit(0)).alias("n"), (-F.col("b.r")).alias("best"))


@add("j21_assignment_diff", f"{ctes('views', 'texts', 'sims')}, a AS (SELECT row_id, text_id FROM (SELECT row_id, text_id, avg(sim) AS v FROM sims GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY v DESC, text_id) = 1), b AS (SELECT row_id, text_id FROM (SELECT row_id, text_id, max(sim) AS v FROM sims GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY v DESC, text_id) = 1) SELECT a.row_id, a.text_id AS was, b.text_id AS now FROM a JOIN b ON a.row_id = b.row_id WHERE a.text_id <> b.text_id")
def _(s, d):
    def assign(mode):
        n = F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("score"), "text_id"))
        return _pooled(s, d, mode).withColumn("n", n).filter("n = 1")

    return assign("mean").select("row_id", F.col("text_id").alias("was")).join(assign("max").select("row_id", F.col("text_id").alias("now")), "row_id").filter("was <> now")


@add("a14_n12_text_embedding", f"{ctes('texts')} SELECT text_id, i, round(t[i], 6) AS x FROM texts, unnest(range(1, 65)) u(i)")
def _(s, d):
    """Mean of unit vectors, normalised again."""
    return X.texts(s, d).select("text_id", F.posexplode("embedding").alias("p", "v")).select("text_id", (F.col("p") + 1).cast("long").alias("i"), F.round("v", 6).alias("x"))


@add("a13_front_contrast", f"{ctes('views')}, c AS (SELECT row_id, view, (e[1] + e[2]) / 2 - (e[3] + e[4]) / 2 AS c FROM views) SELECT row_id, view AS front, round(c, 6) AS contrast FROM c QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY c DESC, view) = 1")
def _(s, d):
    """The view whose mean front probe exceeds its mean back probe most."""
    at = lambda k: F.element_at("embedding", k)
    c = X.views(s, d).select("row_id", "view", ((at(1) + at(2)) / 2 - (at(3) + at(4)) / 2).alias("c"))
    n = F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("c"), "view"))
    return c.withColumn("n", n).filter("n = 1").select("row_id", F.col("view").alias("front"), F.round("c", 6).alias("contrast"))


_CAND = f"{ctes('grid')}, c AS (SELECT model, candidate, avg(score) AS sig, ((model * 37 + candidate * 11) % 100) / 1000.0::DOUBLE AS geo FROM grid GROUP BY ALL)"
_ENS = _CAND + ", w AS (SELECT *, power(least(1, max(geo) OVER m / 0.02), 2) AS wt, CASE WHEN max(geo) OVER m > min(geo) OVER m THEN (geo - min(geo) OVER m) / (max(geo) OVER m - min(geo) OVER m) ELSE 0 END AS ug, CASE WHEN max(sig) OVER m > min(sig) OVER m THEN (sig - min(sig) OVER m) / (max(sig) OVER m - min(sig) OVER m) ELSE 0 END AS us FROM c WINDOW m AS (PARTITION BY model)), e AS (SELECT model, candidate AS up, wt * ug + us AS score, wt * ug + us - lead(wt * ug + us) OVER o AS margin, row_number() OVER o AS n FROM w WINDOW o AS (PARTITION BY model ORDER BY wt * ug + us DESC, candidate))"


def _candidates(s, d):
    c = X.pose_grid(s, d).groupBy("model", "candidate").agg(F.avg("score").alias("sig"))
    return c.withColumn("geo", ((F.col("model") * 37 + F.col("candidate") * 11) % 100) / 1000.0)


@add("a12_n18_n19_ensemble", f"{_ENS} SELECT model, up, round(score, 6) AS score, round(margin, 6) AS margin, margin < 0.45 AS gated FROM e WHERE n = 1")
def _(s, d):
    """Azimuth means, weighted evidence, winner, margin, gate."""
    e = P.ensemble(_candidates(s, d))
    return e.select("model", "up", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"), P.needs_arbiter(F.col("margin")).alias("gated"))


@add("w07_rank_up", f"{_CAND}, r AS (SELECT model, candidate AS up, sig, lead(sig) OVER o AS nxt, row_number() OVER o AS n FROM c WINDOW o AS (PARTITION BY model ORDER BY sig DESC, candidate DESC)) SELECT model, up, round(CASE WHEN sig > 0 THEN nxt / sig ELSE 1 END, 6) AS ratio, round(sig, 6) AS best FROM r WHERE n = 1")
def _(s, d):
    r = P.rank_up(_candidates(s, d).select("model", "candidate", F.col("sig").alias("score")))
    return r.select("model", "up", F.round("ratio", 6).alias("ratio"), F.round("best", 6).alias("best"))


_GRID_COUNTS = "count(*) AS n, count(*) FILTER (WHERE pick = gold) AS right, count(*) FILTER (WHERE margin < 0.45) AS escalates, count(*) FILTER (WHERE pick <> base) AS moved, count(*) FILTER (WHERE pick <> base AND pick = gold) AS fixed, count(*) FILTER (WHERE pick <> base AND base = gold) AS broke"


@add("geo_floor_grid", f"""{_CAND},
u AS (SELECT model, candidate, CASE WHEN max(geo) OVER m > min(geo) OVER m THEN (geo - min(geo) OVER m) / (max(geo) OVER m - min(geo) OVER m) ELSE 0 END AS g, CASE WHEN max(sig) OVER m > min(sig) OVER m THEN (sig - min(sig) OVER m) / (max(sig) OVER m - min(sig) OVER m) ELSE 0 END AS s, greatest(max(geo) OVER m, 0) AS best FROM c WINDOW m AS (PARTITION BY model)),
k AS (SELECT floor, power FROM (SELECT unnest([0.02::DOUBLE, 0.095]) AS floor), (SELECT unnest([0::DOUBLE, 0.5, 1, 2, 99]) AS power)),
w AS (SELECT u.*, floor, power, CASE WHEN power = 0 THEN 1 ELSE power(least(1, best / floor), power) END AS wt FROM u, k),
r AS (SELECT model, floor, power, candidate AS pick, wt, (wt * g + s) AS score, lead(wt * g + s) OVER o AS nxt, row_number() OVER o AS nth FROM w WINDOW o AS (PARTITION BY model, floor, power ORDER BY wt * g + s DESC, candidate)),
a AS (SELECT model, floor, power, pick, (score - nxt) * 2 / (1 + wt) AS margin FROM r WHERE nth = 1),
j AS (SELECT a.*, b.pick AS base, (a.model * 5) % 6 AS gold, 'set' || a.model % 3 AS set FROM a JOIN a AS b ON a.model = b.model AND b.power = 0 AND b.floor = 0.02)
SELECT floor, power, set, {_GRID_COUNTS} FROM j GROUP BY ALL""")
def _(s, d):
    """2.13: a grid of floors and powers in one pass over the candidates, with what moved against the base."""
    c = _candidates(s, d)
    gold = c.select("model").distinct().select("model", ((F.col("model") * 5) % 6).cast("int").alias("gold"), F.concat(F.lit("set"), (F.col("model") % 3).cast("string")).alias("set"))
    return E.geometry_grid(c, gold, [0.02, 0.095], [0, 0.5, 1, 2, 99])


_POSE = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'vlm' ELSE 'geometry' END AS source, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'true' WHEN 2 THEN 'false' ELSE 'rejected' END AS arb, CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id % 100) / 100.0::DOUBLE END AS margin, event_id % 3 > 0 AS av FROM events"


@add("f10_sufficiency", f"WITH p AS ({_POSE}) SELECT event_id, CASE WHEN source IS NULL THEN false WHEN source = 'vlm' THEN true WHEN arb IN ('true', 'rejected') THEN margin IS NOT NULL WHEN margin IS NULL THEN false ELSE NOT (av AND margin < 0.45) END AS ok FROM p")
def _(s, d):
    n = F.col("event_id")
    src = F.when(n % 5 == 0, None).when(n % 5 == 1, "vlm").otherwise("geometry")
    arb = F.when(n % 4 == 0, None).when(n % 4 == 1, "true").when(n % 4 == 2, "false").otherwise("rejected")
    margin = F.when(n % 7 == 0, None).otherwise((n % 100) / 100.0)
    return X.table(s, d, "events").select("event_id", P.sufficient(src, arb, margin, n % 3 > 0).alias("ok"))


@add("f08_valid_up", "SELECT vec_id, coalesce(embedding[1] * (vec_id % 3) <> 0, false) AS ok FROM embeddings")
def _(s, d):
    up = F.transform(F.slice("embedding", 1, 1), lambda x: x.cast("double") * (F.col("vec_id") % 3))
    return X.table(s, d, "embeddings").select("vec_id", P.valid_up(F.concat(up, F.array(F.lit(0.0), F.lit(0.0)))).alias("ok"))


@add("n13_view_angles", "SELECT p_partkey, el, i, round(2 * pi() * i / 8, 6) AS azimuth, round(radians(el), 6) AS elevation FROM (SELECT p_partkey, unnest([p_size - 30.0::DOUBLE, p_size / 2.0::DOUBLE]) AS el FROM part), unnest(range(8)) u(i)")
def _(s, d):
    """Eight views at each of a part's two elevations, elevation by elevation."""
    p = X.table(s, d, "part").select("p_partkey", F.posexplode(P.view_angles(8, F.array((F.col("p_size") - 30).cast("double"), F.col("p_size") / 2.0))).alias("k", "a"))
    return p.select("p_partkey", F.round(F.degrees("a.elevation"), 1).alias("el"), (F.col("k") % 8).cast("long").alias("i"), F.round("a.azimuth", 6).alias("azimuth"), F.round("a.elevation", 6).alias("elevation"))


@add("n15_n16_rotation", "WITH u AS (SELECT vec_id, embedding[1:3]::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, v[1] / sqrt(v[1]**2 + v[2]**2 + v[3]**2) AS x, v[2] / sqrt(v[1]**2 + v[2]**2 + v[3]**2) AS y, v[3] / sqrt(v[1]**2 + v[2]**2 + v[3]**2) AS z FROM u) SELECT vec_id, round(1 - x * x / (1 + z), 5) AS ax, round(-x * y / (1 + z), 5) AS ay, round(-x, 5) AS az FROM n")
def _(s, d):
    """The rotation's first row is the azimuth zero."""
    r = P.rotation_to_z(F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")))
    e = X.table(s, d, "embeddings").select("vec_id", r.alias("r"))
    return e.select("vec_id", *[F.round(F.element_at("r", k + 1), 5).alias(n) for k, n in enumerate(("ax", "ay", "az"))])


@add("a11_geometry", "WITH p AS (SELECT vec_id // 50 AS model, vec_id, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT * FROM (VALUES (0, 1, 0, 0), (1, -1, 0, 0), (2, 0, 1, 0), (3, 0, -1, 0), (4, 0, 0, 1), (5, 0, 0, -1)) t(candidate, ux, uy, uz)), h AS (SELECT model, candidate, e[1] * ux + e[2] * uy + e[3] * uz AS h, e[4] * ux + e[5] * uy + e[6] * uz AS f FROM p, c), s AS (SELECT *, min(h) OVER w AS lo, max(h) OVER w AS hi FROM h WINDOW w AS (PARTITION BY model, candidate)) SELECT model, candidate::INT AS candidate, round(CASE WHEN max(hi - lo) > 0 THEN avg(CASE WHEN h < lo + 0.2 * (hi - lo) AND f < 0 THEN 1.0::DOUBLE ELSE 0 END) ELSE 0 END, 6) AS geo FROM s GROUP BY ALL")
def _(s, d):
    at = lambda k: F.element_at("embedding", k).cast("double")
    p = X.table(s, d, "embeddings").select(F.expr("vec_id div 50").alias("model"), *[at(k + 1).alias(n) for k, n in enumerate(("x", "y", "z", "nx", "ny", "nz"))])
    return P.geometry_evidence(p, 0.2, 0.0).select("model", "candidate", F.round("geo", 6).alias("geo"))


_TAG = " OR ".join(f"contains(b, '{t}')" for t in I.TAGS)


@add("f01_names", f"{ctes('names')}, b AS (SELECT *, regexp_replace(lower(name), '(^|[^a-z])(un|no[nt]?)[\\s_-]*support(ed|s)?', '\\1', 'g') AS b FROM names) SELECT p_partkey, ({_TAG}) AS skipped FROM b")
def _(s, d):
    return X.names(s, d).select("p_partkey", I.skipped(F.col("name")).alias("skipped"))


@add("n01_n03_keys", f"{ctes('names')} SELECT p_partkey, sha1(name || '.stl|' || ((1699999999999999999 - size * 1000000000) // 1000000000) || '|' || size || '|8|384|+Z|tower|pv') AS embed_key, list_last(string_split(name, '/')) || '_' || substr(sha1(name || '.stl'), 1, 6) AS render_key FROM names")
def _(s, d):
    """Keys from identity with whole-second times, default elevations elided."""
    n = X.names(s, d)
    rel = F.concat("name", F.lit(".stl"))
    ident = I.file_identity(rel, F.lit(1699999999999999999) - F.col("size") * 1000000000, F.col("size"))
    return n.select("p_partkey", I.embed_key(ident, 8, 384, F.lit("+Z"), "tower").alias("embed_key"), I.render_key(rel).alias("render_key"))


@add("n07_n10_paths", "SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE url END AS rel, list_last(string_split(url, '/')) AS base FROM pages")
def _(s, d):
    u = X.table(s, d, "pages")
    return u.select("page_id", I.relative(F.col("url"), F.lit("https:/")).alias("rel"), F.element_at(F.split("url", "/"), -1).alias("base"))


_TREES = "src AS (SELECT 'p' || p_partkey AS rel, p_size::BIGINT AS size, p_partkey % 97 AS mtime FROM part WHERE p_partkey % 10 <> 0), dst AS (SELECT 'p' || p_partkey AS rel, p_size::BIGINT + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS size, p_partkey % 89 AS mtime FROM part WHERE p_partkey % 10 <> 1)"


def _trees(s, d):
    p = X.table(s, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("rel"), F.col("p_size").cast("long").alias("size"), F.col("p_partkey").alias("k"))
    src = p.filter("k % 10 <> 0").select("rel", "size", (F.col("k") % 97).alias("mtime"))
    return src, p.filter("k % 10 <> 1").select("rel", (F.col("size") + (F.col("k") % 7 == 0).cast("long")).alias("size"), (F.col("k") % 89).alias("mtime"))


@add("j14_u01_tree_compare", f"WITH {_TREES} SELECT coalesce(s.rel, d.rel) AS rel, CASE WHEN d.rel IS NULL THEN 'missing' WHEN s.rel IS NULL THEN 'extra' WHEN s.size <> d.size THEN 'size' WHEN s.mtime <> d.mtime THEN 'mtime' ELSE 'same' END AS state FROM src s FULL JOIN dst d ON s.rel = d.rel")
def _(s, d):
    return M.compare_trees(*_trees(s, d))


_REKEY = "files AS (SELECT p_name || p_partkey AS rel, 'o' || (p_partkey % 900) AS old_key, 'n' || p_partkey AS new_key FROM part), cache AS (SELECT DISTINCT 'o' || (s_suppkey * 3) AS key, s_suppkey AS value FROM supplier UNION ALL SELECT DISTINCT 'n' || (s_suppkey * 2), s_suppkey + 1000 FROM supplier)"


def _rekey_tables(s, d):
    t = lambda c: F.col(c).cast("string")
    files = X.table(s, d, "part").select(F.concat("p_name", t("p_partkey")).alias("rel"), F.concat(F.lit("o"), (F.col("p_partkey") % 900).cast("string")).alias("old_key"), F.concat(F.lit("n"), t("p_partkey")).alias("new_key"))
    sup = X.table(s, d, "supplier")
    cache = sup.select(F.concat(F.lit("o"), (F.col("s_suppkey") * 3).cast("string")).alias("key"), F.col("s_suppkey").alias("value"))
    return files, cache.union(sup.select(F.concat(F.lit("n"), (F.col("s_suppkey") * 2).cast("string")), F.col("s_suppkey") + 1000))


@add("j10_j12_rekey", f"WITH {_REKEY} SELECT rel, coalesce(n.value, o.value) AS value, CASE WHEN n.value IS NOT NULL AND o.value IS NOT NULL THEN 'superseded' WHEN n.value IS NOT NULL THEN 'already' WHEN o.value IS NOT NULL THEN 'moved' ELSE 'missing' END AS action FROM files f LEFT JOIN cache n ON f.new_key = n.key LEFT JOIN cache o ON f.old_key = o.key")
def _(s, d):
    return M.rekey(*_rekey_tables(s, d))


@add("j11_u02_orphans", f"WITH {_REKEY} SELECT key, value FROM cache WHERE key NOT IN (SELECT old_key FROM files UNION SELECT new_key FROM files)")
def _(s, d):
    return M.orphans(*_rekey_tables(s, d))


@add("j01_j03_store_scan", f"{ctes('views', 'models')} SELECT indexed AS kept, count(*) AS n FROM models GROUP BY 1")
def _(s, d):
    """Files with an embedding are kept, the others counted as missing."""
    files, have = X.models(s, d).select("row_id"), X.views(s, d).select("row_id").distinct()
    return files.join(have, "row_id").agg(F.lit(True).alias("kept"), F.count("*").alias("n")).union(files.join(have, "row_id", "left_anti").agg(F.lit(False), F.count("*")))


@add("s12_render_index", "SELECT split_part(url, '?', 1) AS stem, last(page_id ORDER BY length(html), page_id) AS page_id FROM pages GROUP BY 1")
def _(s, d):
    p = X.table(s, d, "pages").select(F.substring_index("url", "?", 1).alias("stem"), F.length("html").alias("mtime"), F.col("page_id").alias("path"))
    return M.newest_render(p).select("stem", F.col("path").alias("page_id"))


_ZIP = "z AS (SELECT l_orderkey AS zip, CASE WHEN l_orderkey % 3 = 0 THEN 'a/' ELSE l_linenumber || '/' END || CASE WHEN l_orderkey % 11 = 0 THEN '../' ELSE '' END || l_partkey || '.stl' AS name, l_quantity::BIGINT AS size FROM lineitem)"


def _zips(s, d):
    name = F.concat(F.when(F.col("l_orderkey") % 3 == 0, "a/").otherwise(F.concat(F.col("l_linenumber").cast("string"), F.lit("/"))), F.when(F.col("l_orderkey") % 11 == 0, "../").otherwise(""), F.col("l_partkey").cast("string"), F.lit(".stl"))
    return X.table(s, d, "lineitem").select(F.col("l_orderkey").alias("zip"), name.alias("name"), F.col("l_quantity").cast("long").alias("size"))


@add("n26_n27_f12_zip_plan", f"WITH {_ZIP}, g AS (SELECT zip, count(DISTINCT split_part(name, '/', 1)) = 1 AND bool_and(contains(name, '/')) AS in_place, bool_or(starts_with(name, '/') OR list_contains(string_split(name, '/'), '..')) AS unsafe, count(*) AS n, sum(size)::BIGINT AS bytes FROM z GROUP BY 1) SELECT *, CASE WHEN zip % 13 = 0 THEN 'skip-tagged' WHEN unsafe THEN 'unsafe' WHEN zip % 5 = 0 AND zip % 2 = 0 THEN 'repair' WHEN zip % 7 = 0 AND zip % 5 <> 0 THEN 'done' WHEN zip % 4 = 0 THEN 'elsewhere' ELSE 'extract' END AS action FROM g")
def _(s, d):
    """Destination rule, path escapes and the action in its order of precedence."""
    z = M.zip_destination(_zips(s, d)).select("zip", "in_place", "unsafe", "n", "bytes")
    k = F.col("zip")
    return z.withColumn("action", M.zip_action(k % 13 == 0, F.lit(True), F.col("unsafe"), k % 5 == 0, k % 2 == 0, k % 7 == 0, k % 4 == 0))


@add("checksum_copies", "SELECT n_chars, md5(text) AS sum, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def _(s, d):
    """Copies by size and checksum."""
    t = X.table(s, d, "documents")
    return t.groupBy("n_chars", F.md5("text").alias("sum")).agg(F.count("*").alias("n")).filter("n > 1")


@add("w15_w16_r08_retire", f"{ctes('log')}, f AS (SELECT user_id, first(event_id ORDER BY ts, event_id) AS first_id, last(event_id ORDER BY ts, event_id) AS last_id FROM log GROUP BY 1) SELECT * FROM f")
def _(s, d):
    l = X.log(s, d)
    a = T.first_retirements(l, "user_id", ["ts", "event_id"]).select("user_id", F.col("event_id").alias("first_id"))
    return a.join(T.last_row_wins(l, "user_id", ["ts", "event_id"]).select("user_id", F.col("event_id").alias("last_id")), "user_id")


@add("w13_r07_breaker", f"{ctes('log')}, r AS (SELECT *, sum(CASE WHEN outcome IN ('answer', 'rejected') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM log) SELECT user_id, run, count(*) AS failures, epoch(date_trunc('second', max(ts)))::BIGINT - epoch(date_trunc('second', min(ts)))::BIGINT AS span_s, count(*) >= 5 AND epoch(date_trunc('second', max(ts)))::BIGINT - epoch(date_trunc('second', min(ts)))::BIGINT >= 60 AS tripped FROM r WHERE outcome IN ('unavailable', 'failed') GROUP BY ALL")
def _(s, d):
    return T.failure_streaks(X.log(s, d))


@add("w14_r14_pacing", f"{ctes('log')}, n AS (SELECT user_id, event_id, epoch(date_trunc('second', ts))::BIGINT AS arrival, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, ts FROM log) SELECT user_id, event_id, arrival, max(arrival - i * 3600) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + i * 3600 AS start FROM n")
def _(s, d):
    return T.paced_starts(X.log(s, d), 3600)


@add("w17_r01_in_flight", f"{ctes('log')} SELECT user_id, event_id, sum(CASE outcome WHEN 'answer' THEN -1 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS in_flight FROM log")
def _(s, d):
    moves = X.log(s, d).withColumn("change", F.when(F.col("outcome") == "answer", -1).otherwise(1))
    return T.in_flight(moves).select("user_id", "event_id", "in_flight")


@add("r09_stalls", f"{ctes('log')}, g AS (SELECT user_id, epoch(date_trunc('second', ts))::BIGINT - epoch(date_trunc('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)))::BIGINT AS gap FROM log) SELECT user_id, max(gap) AS longest, count_if(gap > 240) AS stalls FROM g GROUP BY 1")
def _(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    g = X.log(s, d).withColumn("gap", F.unix_seconds("ts") - F.unix_seconds(F.lag("ts").over(w)))
    return g.groupBy("user_id").agg(F.max("gap").alias("longest"), F.count_if(F.col("gap") > 240).alias("stalls"))


_PRED = "p AS (SELECT l.doc_id, l.quality AS gold, d.lang AS set, CASE WHEN d.n_chars >= 500 THEN 1 ELSE 0 END AS a, CASE WHEN l.toxic = 0 THEN 1 ELSE 0 END AS b, (d.n_chars % 100) / 100.0::DOUBLE AS margin FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def _pred(s, d):
    j = X.table(s, d, "labels").join(X.table(s, d, "documents"), "doc_id")
    return j.select("doc_id", F.col("quality").alias("gold"), F.col("lang").alias("set"), (F.col("n_chars") >= 500).cast("int").alias("a"), (F.col("toxic") == 0).cast("int").alias("b"), ((F.col("n_chars") % 100) / 100.0).alias("margin"))


@add("a17_j18_u04_accuracy", f"WITH {_PRED}, m AS (SELECT 'a' AS method, set, gold, a AS pick FROM p UNION ALL SELECT 'b', set, gold, b FROM p), s AS (SELECT * FROM m UNION ALL SELECT method, 'en+de', gold, pick FROM m WHERE set IN ('en', 'de')) SELECT method, set AS of, count_if(pick = gold) AS right, count(*) AS n FROM s GROUP BY ALL".replace(" AS of,", ' AS "of",').replace(" AS right,", ' AS "right",'))
def _(s, d):
    long = _pred(s, d).select("set", "gold", F.expr("stack(2, 'a', a, 'b', b) as (method, pick)"))
    return E.accuracy(long, {"en+de": ["en", "de"]})


@add("a18_distribution", f"WITH {_PRED} SELECT set, count_if(a = 0) AS zero, count_if(a = 1) AS one FROM p GROUP BY 1")
def _(s, d):
    return _pred(s, d).groupBy("set").pivot("a", [0, 1]).count().select("set", F.coalesce("0", F.lit(0)).alias("zero"), F.coalesce("1", F.lit(0)).alias("one"))


@add("a19_a33_rescue", f"""WITH {_PRED} SELECT set, count_if(margin < 0.45) AS fired, count_if(margin < 0.45 AND a <> gold AND b = gold) AS rescued, count_if(margin < 0.45 AND a = gold AND b <> gold) AS broke, count_if(CASE WHEN margin < 0.45 THEN b ELSE a END = gold) AS "right", count(*) AS n, count_if(margin < 0.45 AND a <> gold AND b = gold) - count_if(margin < 0.45 AND a = gold AND b <> gold) AS net FROM p GROUP BY 1""")
def _(s, d):
    return E.rescue(_pred(s, d).withColumnsRenamed({"a": "ensemble", "b": "arbiter"}), 0.45)


@add("j19_n31_flips", f"WITH {_PRED} SELECT doc_id, CASE WHEN a = gold AND b = gold THEN 'right' WHEN b = gold THEN 'fixed' WHEN a = gold THEN 'broken' WHEN a = b THEN 'wrong' ELSE 'wrong->wrong' END AS verdict FROM p")
def _(s, d):
    return _pred(s, d).select("doc_id", E.verdict(F.col("a"), F.col("b"), F.col("gold")).alias("verdict"))


@add("a22_a23_quantiles", f"WITH {_PRED} SELECT set, round(quantile_cont(margin, 0.25), 6) AS q25, round(quantile_cont(margin, 0.5), 6) AS q50, round(quantile_cont(margin, 0.75), 6) AS q75, count(*) AS n FROM p GROUP BY 1")
def _(s, d):
    q = E.margin_quantiles(_pred(s, d), "set")
    return q.select("set", *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")], "n")


@add("f16_f17_at_risk", f"WITH {_PRED}, r AS (SELECT doc_id, abs(margin - 0.45) <= 0.05 OR margin <= 0.05 AS at_risk, margin FROM p), c AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n, count(*) OVER () AS total FROM r WHERE NOT at_risk) SELECT doc_id, 'at_risk' AS part FROM r WHERE at_risk UNION ALL SELECT doc_id, 'control' FROM c WHERE (n - 1) % (total // 20) = 0 AND (n - 1) // (total // 20) < 20")
def _(s, d):
    """Rows near the gate, and a systematic control sample of twenty (the sampling is the feature)."""
    p = _pred(s, d)
    risk = (F.abs(F.col("margin") - 0.45) <= 0.05) | (F.col("margin") <= 0.05)
    safe = p.filter(~risk).select("doc_id")
    step = safe.agg(F.greatest(F.lit(1), F.expr("count(*) div 20")).alias("step"))
    placed = numbered(safe, "doc_id").select("doc_id", F.col("nth").alias("n")).crossJoin(F.broadcast(step))
    control = placed.filter("n % step = 0 and n div step < 20").select("doc_id", F.lit("control").alias("part"))
    return p.filter(risk).select("doc_id", F.lit("at_risk").alias("part")).union(control)


@add("a20_n29_cost", "SELECT role, round(avg((length(text) * 0.3 + (turn + 1) * 2.5) / 1e6), 9) AS cost, count(*) AS n FROM conversations GROUP BY 1")
def _(s, d):
    c = E.token_cost(F.length("text"), F.lit(0), F.col("turn") + 1, F.lit(0.3), F.lit(2.5))
    return X.table(s, d, "conversations").groupBy("role").agg(F.round(F.avg(c), 9).alias("cost"), F.count("*").alias("n"))


@add("a21_u03_set_flips", f"{_BASE}, a AS (SELECT row_id, list(text_id ORDER BY score DESC, text_id)[1:3] AS t FROM pooled GROUP BY 1), q AS (SELECT row_id, text_id, avg(sim) AS v FROM sims GROUP BY ALL), b AS (SELECT row_id, list(text_id ORDER BY v DESC, text_id)[1:3] AS t FROM q GROUP BY 1) SELECT count_if(a.t[1] <> b.t[1]) AS flips, count_if(list_sort(a.t) <> list_sort(b.t)) AS set_changes, count_if(a.t <> b.t) AS order_changes FROM a JOIN b ON a.row_id = b.row_id")
def _(s, d):
    def top(mode, name):
        n = F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("score"), "text_id"))
        r = _pooled(s, d, mode).withColumn("n", n).filter("n <= 3")
        return r.groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text_id"))), lambda x: x.text_id).alias(name))

    j = top("softmax", "a").join(top("mean", "b"), "row_id")
    return j.agg(F.count_if(F.element_at("a", 1) != F.element_at("b", 1)).alias("flips"), F.count_if(F.array_sort("a") != F.array_sort("b")).alias("set_changes"), F.count_if(F.col("a") != F.col("b")).alias("order_changes"))


@add("a24_a25_stages", "SELECT event_type AS stage, count(*) AS calls, round(sum(value), 2) AS total, round(100 * sum(value) / sum(sum(value)) OVER (), 4) AS share, round(avg(CASE WHEN value >= 0 THEN value END), 6) AS mean FROM events GROUP BY 1")
def _(s, d):
    t = X.table(s, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("calls"), F.sum("value").alias("t"), F.avg(F.when(F.col("value") >= 0, F.col("value"))).alias("m"))
    return t.select("stage", "calls", F.round("t", 2).alias("total"), F.round(100 * F.col("t") / F.sum("t").over(Window.partitionBy()), 4).alias("share"), F.round("m", 6).alias("mean"))


@add("a26_determinism", "SELECT md5(text) AS hash, count(DISTINCT lang) = 1 AS stable, max(n_chars) - min(n_chars) AS delta FROM documents GROUP BY 1")
def _(s, d):
    return X.table(s, d, "documents").groupBy(F.md5("text").alias("hash")).agg((F.countDistinct("lang") == 1).alias("stable"), (F.max("n_chars") - F.min("n_chars")).alias("delta"))


@add("n22_retry_class", "SELECT event_id, CASE WHEN c IN (429, 503) THEN 'rate_limited' WHEN c IN (401, 403, 404, 408, 409, 425) OR c >= 500 THEN 'transient' WHEN c >= 400 THEN 'rejected' ELSE 'ok' END AS class FROM (SELECT event_id, 200 + event_id % 330 AS c FROM events)")
def _(s, d):
    c = F.col("event_id") % 330 + 200
    return X.table(s, d, "events").select("event_id", T.retry_class(c).alias("class"))


@add("a09_x08_w09_clusters")
def _(s, d):
    """K-means on mean view vectors, the best of several seeds; clusters by size, members by distance."""
    from polyview.operators.cluster import clusters

    return clusters(X.views(s, d), 10)


@add("u05_fired_difference", f"WITH {_PRED} SELECT doc_id, 'a' AS only FROM p WHERE margin < 0.45 AND NOT margin < 0.3 UNION ALL SELECT doc_id, 'b' FROM p WHERE margin >= 0.95".replace(" AS only", ' AS "only"'))
def _(s, d):
    p = _pred(s, d)
    a, b = p.filter("margin < 0.45").select("doc_id"), p.filter("margin < 0.3 or margin >= 0.95").select("doc_id")
    return a.exceptAll(b).withColumn("only", F.lit("a")).union(b.exceptAll(a).withColumn("only", F.lit("b")))


@add("w11_k08_pages", "SELECT doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 12 AS page FROM documents")
def _(s, d):
    """Twelve models a sheet of a language; a language is numbered in ranges."""
    return numbered_within(X.table(s, d, "documents").select("doc_id", "lang"), "lang", ["doc_id"]).select("doc_id", F.expr("nth div 12").alias("page"))


@add("a16_bounding_box", "SELECT label, round((max(x) + min(x)) / 2, 6) AS centre_x, round((max(y) + min(y)) / 2, 6) AS centre_y, round((max(z) + min(z)) / 2, 6) AS centre_z, round(max(x) - min(x), 6) AS extent_x, round(max(y) - min(y), 6) AS extent_y, round(max(z) - min(z), 6) AS extent_z, round(sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2 + (max(z) - min(z)) ** 2) * 1.4, 6) AS radius FROM (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings) GROUP BY 1")
def _(s, d):
    v = X.table(s, d, "embeddings").select("label", *[F.element_at("embedding", k + 1).cast("double").alias(a) for k, a in enumerate("xyz")])
    out = C.bounding_box(v, "label")
    return out.select("label", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


_ORBIT = "o AS (SELECT vec_id, radians(vec_id % 8 * 45.0) AS a, radians(vec_id % 5 * 20.0 - 10.0) AS e, 1.0 + vec_id % 3 AS r FROM embeddings), l AS (SELECT *, -cos(a) * cos(e) AS lx, -sin(a) * cos(e) AS ly, -sin(e) - 0.6 AS lz FROM o)"


@add("n17_orbit_camera", f"WITH {_ORBIT} SELECT vec_id, round(0.5 - r * lx, 6) AS eye_x, round(0.25 - r * ly, 6) AS eye_y, round(r * sin(e), 6) AS eye_z, round(-cos(a) * sin(e), 6) + 0 AS up_x, round(-sin(a) * sin(e), 6) + 0 AS up_y, round(cos(e), 6) AS up_z, round(lx / sqrt(lx * lx + ly * ly + lz * lz), 6) + 0 AS light_x, round(ly / sqrt(lx * lx + ly * ly + lz * lz), 6) + 0 AS light_y, round(lz / sqrt(lx * lx + ly * ly + lz * lz), 6) + 0 AS light_z FROM l")
def _(s, d):
    e = X.table(s, d, "embeddings").select("vec_id", F.radians(F.col("vec_id") % 8 * 45.0).alias("a"), F.radians(F.col("vec_id") % 5 * 20.0 - 10.0).alias("e"), (1.0 + F.col("vec_id") % 3).alias("r"))
    cam = C.orbit_camera((F.lit(0.5), F.lit(0.25), F.lit(0.0)), F.col("r"), F.col("a"), F.col("e"))
    return e.select("vec_id", *[(F.round(c, 6) + 0).alias(n) for n, c in cam.items()])


@add("n04_n05_view_config", "SELECT e.event_id, printf('%g', value) AS number, concat(event_id % 16, 'v-e', printf('%g', value), ',', printf('%g', -value / 1000)) AS config, concat('384px-', event_id % 16, 'v-e', printf('%g', value), ',', printf('%g', -value / 1000)) AS folder FROM events e WHERE value IS NOT NULL")
def _(s, d):
    n, el = F.col("event_id") % 16, F.array(F.col("value"), -F.col("value") / 1000)
    return X.table(s, d, "events").filter("value is not null").select("event_id", I.general_number(F.col("value")).alias("number"), I.view_config(n, el).alias("config"), I.render_folder(F.lit(384), n, el).alias("folder"))


@add("n06_up_token", "SELECT vec_id, CASE WHEN vec_id % 5 > 1 THEN concat(vec_id % 3 - 1, ',0,', CASE WHEN vec_id % 3 = 1 THEN 1 ELSE 0 END) WHEN vec_id % 3 = 0 THEN '0,0,1' WHEN vec_id % 3 = 1 THEN '0,1,0' ELSE 'unresolved' END AS token FROM embeddings")
def _(s, d):
    """A null vector (remainder 0) and a zero one (remainder 1) count as no pose."""
    k, m = F.col("vec_id") % 5, F.col("vec_id") % 3
    up = F.when(k == 1, F.array(*[F.lit(0.0)] * 3)).when(k > 1, F.array((m - 1).cast("double"), F.lit(0.0), (m == 1).cast("double")))
    axis = F.when(m == 0, "z").when(m == 1, "y").otherwise("auto")
    return X.table(s, d, "embeddings").select("vec_id", I.up_token(up, axis).alias("token"))


@add("n08_root_note", "SELECT p_partkey, CASE WHEN p_partkey % 6 IN (0, 1) THEN '/lib' WHEN p_partkey % 6 = 2 THEN '/lib' WHEN p_partkey % 6 = 3 THEN '/' || p_brand WHEN p_partkey % 6 = 4 THEN '/lib' ELSE '/lib/kit' END AS root, CASE p_partkey % 6 WHEN 2 THEN 'subdir' WHEN 3 THEN 'mismatch' WHEN 4 THEN 'superdir' END AS note FROM part")
def _(s, d):
    """Equal, loose file, below, elsewhere, above, nothing recorded."""
    k = F.col("p_partkey") % 6
    root = F.when(k == 0, "/lib").when(k == 1, "/tmp").when(k == 2, F.concat(F.lit("/lib/"), "p_brand")).when(k == 3, F.concat(F.lit("/"), "p_brand")).when(k == 4, "/lib").otherwise("/lib/kit")
    recorded = F.when(k == 4, "/lib/kit").when(k < 4, "/lib")
    found = I.root_note(root, recorded, k == 1)
    return X.table(s, d, "part").select("p_partkey", found["root"].alias("root"), found["note"].alias("note"))


@add("a27_action_totals", f"{ctes('names')} SELECT CASE WHEN p_partkey % 6 IN (1, 3, 4) THEN 'skip-tagged' ELSE 'extract' END AS action, count(*) AS n, sum(size)::BIGINT AS bytes FROM names GROUP BY 1")
def _(s, d):
    return M.action_totals(X.names(s, d).select(F.when(I.skipped(F.col("name")), "skip-tagged").otherwise("extract").alias("action"), "size"))


@add("a28_walk_counts", "SELECT count(*) FILTER (WHERE p_partkey % 10 > 1) AS kept, count(*) FILTER (WHERE p_partkey % 10 = 1) AS vanished, count(*) FILTER (WHERE p_partkey % 10 = 0) AS \"new\" FROM part")
def _(s, d):
    rel = X.table(s, d, "part").select(F.col("p_partkey").alias("rel"))
    return M.walk_counts(rel.filter("rel % 10 <> 0"), rel.filter("rel % 10 <> 1"))


_POSES = "poses AS (SELECT vec_id AS id, ['geometry', 'ensemble', 'vlm'][vec_id % 3 + 1] AS source, CASE vec_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS arbitrated FROM embeddings)"


def _poses(s, d):
    source = F.element_at(F.array(*map(F.lit, ["geometry", "ensemble", "vlm"])), (F.col("vec_id") % 3 + 1).cast("int"))
    return X.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), source.alias("source"), F.when(F.col("vec_id") % 4 == 0, True).when(F.col("vec_id") % 4 == 1, False).alias("arbitrated"))


@add("a29_pose_census", f"WITH {_POSES} SELECT source, arbitrated, count(*) AS n FROM poses GROUP BY ALL")
def _(s, d):
    return M.pose_census(_poses(s, d))


@add("k14_kept_poses", f"WITH {_POSES} SELECT * FROM poses WHERE source = 'vlm'")
def _(s, d):
    return M.kept_poses(_poses(s, d))


@add("a30_image_delta", "SELECT row_id, list_max(t) AS max_delta, len(list_filter(t, lambda x: x > 0)) AS n_differing, round(len(list_filter(t, lambda x: x > 0)) / len(t), 6) AS share FROM (SELECT a.vec_id // 2 AS row_id, list_transform(list_zip(a.embedding, b.embedding), lambda p: abs(floor(p[1]::DOUBLE * 16)::BIGINT - floor(p[2]::DOUBLE * 16)::BIGINT)) AS t FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1)")
def _(s, d):
    e = X.table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 16)).alias("p"))
    a, b = e.filter("vec_id % 2 = 0").select(F.expr("vec_id div 2").alias("row_id"), F.col("p").alias("a")), e.filter("vec_id % 2 = 1").select(F.expr("vec_id div 2").alias("row_id"), F.col("p").alias("b"))
    got = E.image_delta(F.col("a"), F.col("b"))
    return a.join(b, "row_id").select("row_id", got["max_delta"].alias("max_delta"), got["n_differing"].alias("n_differing"), F.round(got["share"], 6).alias("share"))


_ANSWERS = "q AS (SELECT l.doc_id AS stem, l.quality AS gold, (d.n_chars >= 500)::INT AS long, CASE WHEN l.doc_id % 7 <> 0 THEN 1 - l.toxic END AS clean FROM labels l JOIN documents d ON l.doc_id = d.doc_id), answers AS (SELECT stem, gold, 'long' AS config, long AS pick FROM q UNION ALL SELECT stem, gold, 'clean', clean FROM q)"


def _answers(s, d):
    q = X.table(s, d, "labels").join(X.table(s, d, "documents").select("doc_id", "n_chars"), "doc_id")
    picks = F.array(F.struct(F.lit("long").alias("config"), (F.col("n_chars") >= 500).cast("int").alias("pick")), F.struct(F.lit("clean").alias("config"), F.when(F.col("doc_id") % 7 != 0, (1 - F.col("toxic")).cast("int")).alias("pick")))
    return q.select(F.col("doc_id").alias("stem"), F.col("quality").alias("gold"), F.inline(picks))


@add("a34_config_accuracy", f"WITH {_ANSWERS} SELECT config, count(*) FILTER (WHERE pick = gold) AS \"right\", count(*) FILTER (WHERE pick IS NULL) AS unanswered, count(*) AS n FROM answers GROUP BY 1")
def _(s, d):
    return E.config_accuracy(_answers(s, d))


@add("a34_disagreeing", f"WITH {_ANSWERS} SELECT stem, count(DISTINCT coalesce(pick, -1)) > 1 AS disagree FROM answers GROUP BY 1")
def _(s, d):
    return E.disagreeing(_answers(s, d))


@add("a34_changed_answers", f"WITH {_ANSWERS} SELECT b.config, a.stem, a.pick AS before, b.pick AS after FROM answers a JOIN answers b ON a.stem = b.stem AND a.config = 'long' AND b.config = 'clean' WHERE a.pick IS DISTINCT FROM b.pick".replace("AS before", 'AS "before"').replace("AS after", 'AS "after"'))
def _(s, d):
    return E.changed_answers(_answers(s, d), "long")


@add("a31_sweep_noise", "WITH b AS (SELECT user_id % 8 + 1 AS batch, median(abs(value) + 1) AS mid, (max(abs(value) + 1) - min(abs(value) + 1)) / median(abs(value) + 1) AS jitter FROM events GROUP BY 1), o AS (SELECT (max(batch / mid) - min(batch / mid)) / median(batch / mid) AS spread, median(jitter) AS jitter FROM b) SELECT round(spread, 6) AS spread, round(jitter, 6) AS jitter, spread <= 2 * jitter AS flat FROM o")
def _(s, d):
    e = X.table(s, d, "events").select((F.col("user_id") % 8 + 1).alias("batch"), (F.abs("value") + 1).alias("seconds"))
    return E.sweep_noise(e).select(F.round("spread", 6).alias("spread"), F.round("jitter", 6).alias("jitter"), "flat")


@add("a32_resident_bytes", "WITH m AS (SELECT user_id, event_id, sum(CASE WHEN event_type = 'error' THEN -2 ELSE 1 END * (event_id % 100)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS resident FROM events) SELECT *, resident > 500 AS over FROM m".replace("AS over", 'AS "over"'))
def _(s, d):
    sign = F.when(F.col("event_type") == "error", -2).otherwise(1)
    moves = X.table(s, d, "events").select("user_id", "event_id", "ts", (sign * (F.col("event_id") % 100)).cast("long").alias("bytes"))
    return T.resident_bytes(moves, "user_id", ["ts", "event_id"], 500).select("user_id", "event_id", "resident", "over")


@add("a35_benchmark_sample", f"{ctes('views', 'models')}, {_POSES}, p AS (SELECT row_id, rel, split_part(rel, '/', 1) AS root FROM models JOIN poses ON row_id = id), n AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY row_id) - 1 AS nth, greatest(1, count(*) OVER (PARTITION BY root) // 5) AS step FROM p) SELECT row_id, rel, root FROM n WHERE nth % step = 0 AND nth < step * 5")
def _(s, d):
    """Five posed models of every collection, evenly spaced."""
    posed = X.models(s, d).join(_poses(s, d).select(F.col("id").alias("row_id")), "row_id").select("row_id", "rel", F.substring_index("rel", "/", 1).alias("root"))
    return E.every_kth(posed, "root", "row_id", 5)


@add("n23_call_outcome", "SELECT event_id, CASE event_id % 11 WHEN 7 THEN 'rate_limited' WHEN 8 THEN 'unavailable' WHEN 9 THEN 'rejected' WHEN 10 THEN 'unavailable' ELSE CASE event_id % 7 WHEN 0 THEN 'answered' WHEN 1 THEN 'rejected' WHEN 3 THEN 'rejected' ELSE 'unavailable' END END AS outcome FROM events")
def _(s, d):
    """An answer, a verdict, no room to answer, a blocked prompt, a torn body, an empty one, none."""
    bodies = ['{"candidates":[{"finishReason":"STOP","content":{"parts":[{"text":"3"}]}}]}', '{"candidates":[{"finishReason":"SAFETY"}]}', '{"candidates":[{"finishReason":"MAX_TOKENS","content":{"parts":[]}}]}', '{"promptFeedback":{"blockReason":"OTHER"}}', '{"candid', "{}", None]
    k = F.col("event_id") % 11
    status = F.when(k == 7, 429).when(k == 8, 404).when(k == 9, 400).when(k < 7, 200)
    body = F.element_at(F.array(*map(F.lit, bodies)), (F.col("event_id") % 7 + 1).cast("int"))
    return X.table(s, d, "events").select("event_id", T.call_outcome(status, body).alias("outcome"))


from polyview.plans import meshes, sweeps, upkeep  # noqa: E402, F401  (they register their queries)
