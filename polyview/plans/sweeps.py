"""Registered comparisons of runs, over the labelled documents and the vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from polyview.operators import retrieval as R
from polyview.operators import sweeps as S
from polyview.plans import fixtures as X
from polyview.plans.fixtures import ctes
from polyview.plans.registry import add

#: A labelled document stands for a model: its gold is one of six, and its arms' picks and margins follow from its numbers.
_ROWS = """r AS (SELECT l.doc_id, d.lang AS set, (l.doc_id % 6)::INT AS gold, d.n_chars AS n, l.quality AS q, (d.n_chars % 97) / 97.0::DOUBLE AS m_a, ((d.n_chars * 7 + l.doc_id) % 101) / 101.0::DOUBLE AS m_b,
  (CASE WHEN d.n_chars % 4 = 0 THEN (l.doc_id + 1) % 6 ELSE l.doc_id % 6 END)::INT AS a, (CASE WHEN (d.n_chars + l.quality) % 3 = 0 THEN (l.doc_id + 2) % 6 ELSE l.doc_id % 6 END)::INT AS b FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def _rows(s, d):
    r = X.table(s, d, "labels").join(X.table(s, d, "documents").select("doc_id", F.col("lang").alias("set"), F.col("n_chars").alias("n")), "doc_id")
    i, n, q = F.col("doc_id"), F.col("n"), F.col("quality")
    pick = lambda wrong, by: F.when(wrong, (i + by) % 6).otherwise(i % 6).cast("int")
    return r.select("doc_id", "set", (i % 6).cast("int").alias("gold"), "n", q.alias("q"), (n % 97 / 97.0).alias("m_a"), ((n * 7 + i) % 101 / 101.0).alias("m_b"), pick(n % 4 == 0, 1).alias("a"), pick((n + q) % 3 == 0, 2).alias("b"))


@add("score_precision", f"""{ctes('views', 'texts')},
e AS (SELECT row_id, view, p, CASE p WHEN 'low' THEN list_transform(e, lambda x: round(x, 2)) WHEN 'base' THEN list_transform(e, lambda x: round(x, 4)) ELSE e END AS e FROM views, (SELECT unnest(['low', 'base', 'high']) AS p)),
sims AS (SELECT row_id, view, text_id, p, list_dot_product(e, t) AS sim FROM e, texts), mx AS (SELECT *, max(sim) OVER (PARTITION BY row_id, text_id, p) AS m FROM sims),
s AS (SELECT p, row_id, text_id, unnest([struct_pack(mode := 'mean', v := avg(sim)), struct_pack(mode := 'max', v := max(sim)), struct_pack(mode := 'softmax', v := sum(exp(50 * (sim - m)) * sim) / sum(exp(50 * (sim - m))))]) AS x FROM mx GROUP BY p, row_id, text_id),
o AS (SELECT x.mode AS mode, p, row_id, list(text_id ORDER BY round(x.v, 9) DESC, text_id) AS t, list(round(x.v, 9) ORDER BY round(x.v, 9) DESC, text_id) AS v FROM s GROUP BY ALL),
j AS (SELECT b.mode, a.t[1:3] AS a, b.t[1:3] AS b, c.t[1:3] AS c, b.v[1] - b.v[2] AS margin FROM o AS b JOIN o AS a ON a.mode = b.mode AND a.row_id = b.row_id AND a.p = 'low' JOIN o AS c ON c.mode = b.mode AND c.row_id = b.row_id AND c.p = 'high' WHERE b.p = 'base')
SELECT mode, count(*) AS n, count(*) FILTER (WHERE a[1] <> b[1]) AS top1_flips, count(*) FILTER (WHERE list_sort(a) <> list_sort(b)) AS top3_set, count(*) FILTER (WHERE a <> b) AS top3_order, count(*) FILTER (WHERE b[1] <> c[1]) AS high_flips,
  count(*) FILTER (WHERE margin < 0.003) AS below_drift, count(*) FILTER (WHERE margin < 0.006) AS below_twice, round(min(margin), 7) AS least, round(quantile_cont(margin, 0.01), 7) AS p1, round(median(margin), 7) AS median FROM j GROUP BY mode""")
def _(s, d):
    """2.13 score_precision: three precisions of the views by three pools."""
    views, texts = X.views(s, d), X.texts(s, d)
    parts = []
    rounded = lambda digits: F.transform("embedding", lambda x: F.round(x, digits))
    for name, digits in (("low", 2), ("base", 4), ("high", None)):
        v = views if digits is None else views.withColumn("embedding", rounded(digits))
        parts += [R.pooled_scores(v, texts, mode).select(F.lit(mode).alias("mode"), F.lit(name).alias("precision"), "row_id", "text_id", F.round("score", 9).alias("score")) for mode in R.POOLS]
    out = S.precision_report(reduce(lambda a, b: a.unionByName(b), parts), "low", "base", "high", 0.003)
    return out.select("mode", "n", "top1_flips", "top3_set", "top3_order", "high_flips", "below_drift", "below_twice", *[F.round(c, 7).alias(c) for c in ("least", "p1", "median")])


@add("compile_flips_groups", f"""WITH {_ROWS}, g AS (SELECT CASE WHEN m_a < 0.3 THEN 'at-risk' ELSE 'control' END AS "group", a, b, abs(m_b - m_a) AS drift FROM r)
SELECT "group", count(*) AS n, count(*) FILTER (WHERE a <> b) AS flips, round(max(drift), 6) AS most, round(median(drift), 6) AS median FROM g GROUP BY 1""")
def _(s, d):
    """2.13 compile_flips: flips and drift of the rows at risk and of the control."""
    g = _rows(s, d).select(F.when(F.col("m_a") < 0.3, "at-risk").otherwise("control").alias("group"), F.col("a").alias("before"), F.col("b").alias("after"), F.abs(F.col("m_b") - F.col("m_a")).alias("drift"))
    return S.flip_groups(g).select("group", "n", "flips", F.round("most", 6).alias("most"), F.round("median", 6).alias("median"))


@add("compile_pose_flips", f"""WITH {_ROWS}, c AS (SELECT m_a AS cached, m_b AS live, m_b + (n % 11 - 5) / 50.0::DOUBLE AS eager, m_b + (n % 7 - 3) / 50.0::DOUBLE AS compiled, a, b, abs(m_b - m_a) AS moved, abs(m_b - 0.45) <= 0.1 OR m_b <= 0.1 AS exposed FROM r),
k AS (SELECT *, CASE WHEN exposed THEN abs(eager - compiled) END AS delta FROM c)
SELECT count(*) AS n, count(*) FILTER (WHERE abs(live - 0.45) <= 0.1) AS in_gate, count(*) FILTER (WHERE live <= 0.1) AS in_zero, count(*) FILTER (WHERE exposed) AS compared, count(*) FILTER (WHERE exposed AND (eager < 0.45) <> (compiled < 0.45)) AS gate_flips,
  count(*) FILTER (WHERE exposed AND a <> b) AS up_flips, count(*) FILTER (WHERE exposed AND abs(eager - 0.45) <= 0.1) AS still_gate, count(*) FILTER (WHERE exposed AND eager <= 0.1) AS still_zero, round(max(moved), 6) AS most_moved, round(max(delta), 6) AS most_delta,
  round(median(moved), 6) AS median_moved, round(quantile_cont(moved, 0.9), 6) AS p90_moved, round(median(delta), 6) AS median_delta FROM k""")
def _(s, d):
    """2.13 compile_pose_flips: a census of margins, and the exposed part compared."""
    r = _rows(s, d)
    c = r.select(F.col("m_a").alias("cached"), F.col("m_b").alias("live"), (F.col("m_b") + (F.col("n") % 11 - 5) / 50.0).alias("eager"), (F.col("m_b") + (F.col("n") % 7 - 3) / 50.0).alias("compiled"), F.col("a").alias("up_a"), F.col("b").alias("up_b"))
    out = S.pose_flips(c, 0.1)
    return out.select(*[F.round(c, 6).alias(c) if c.startswith(("most", "median", "p90")) else F.col(c) for c in out.columns])


@add("backbone_head_to_head", f"""WITH {_ROWS}, z AS (SELECT size, CASE WHEN n % size = 1 THEN (gold + 3) % 6 ELSE a END AS a, b, gold FROM r, (SELECT unnest([2, 5, 384]) AS size))
SELECT size::INT AS size, count(*) AS n, count(*) FILTER (WHERE a <> b) AS differ, count(*) FILTER (WHERE a <> b AND a = gold) AS a_right, count(*) FILTER (WHERE a <> b AND b = gold) AS b_right, count(*) FILTER (WHERE a <> b AND a <> gold AND b <> gold) AS both_wrong FROM z GROUP BY 1""")
def _(s, d):
    """2.13 backbone_sweep: where two backbones differ, by render size."""
    z = _rows(s, d).withColumn("size", F.explode(F.array(F.lit(2), F.lit(5), F.lit(384))))
    return S.head_to_head(z.withColumn("a", F.when(F.col("n") % F.col("size") == 1, (F.col("gold") + 3) % 6).otherwise(F.col("a"))))


@add("pose_probe_deltas", f"""WITH {_ROWS}, p AS (SELECT 'm' || n % 2 AS model, probe, set, CASE probe WHEN 'production' THEN a WHEN 'short' THEN b ELSE (a + b) % 6 END AS pick, gold FROM r, (SELECT unnest(['production', 'short', 'both']) AS probe)),
s AS (SELECT *, unnest(CASE WHEN set IN ('en', 'de') THEN [set, 'en+de'] ELSE [set] END) AS of FROM p), k AS (SELECT model, of, probe, count(*) FILTER (WHERE pick = gold) AS "right", count(*) AS n FROM s GROUP BY ALL)
SELECT k.model, k.of, k.probe, k."right", k.n, k."right" - g."right" AS delta FROM k LEFT JOIN k AS g ON g.model = k.model AND g.of = k.of AND g.probe = 'production'""")
def _(s, d):
    """2.13 pose_probe_sweep: accuracy of each wording, against the one in production."""
    pick = F.when(F.col("probe") == "production", F.col("a")).when(F.col("probe") == "short", F.col("b")).otherwise((F.col("a") + F.col("b")) % 6)
    p = _rows(s, d).withColumn("probe", F.explode(F.array(*map(F.lit, ("production", "short", "both"))))).select(F.concat(F.lit("m"), (F.col("n") % 2).cast("string")).alias("model"), "probe", "set", pick.alias("pick"), "gold")
    return S.probe_deltas(p, "production", {"en+de": ["en", "de"]})


@add("parser_gate_arms", f"""WITH {_ROWS}, z AS (SELECT *, (a + q) % 6 AS geo_a, (b + n) % 6 AS geo_b, unnest([set, 'all']) AS of FROM r)
SELECT of, count(*) AS n, count(*) FILTER (WHERE a = gold) AS a_right, count(*) FILTER (WHERE b = gold) AS b_right, count(*) FILTER (WHERE geo_a = gold) AS geo_a_right, count(*) FILTER (WHERE geo_b = gold) AS geo_b_right, count(*) FILTER (WHERE a <> b) AS moved, count(*) FILTER (WHERE geo_a <> geo_b) AS geo_moved,
  count(*) FILTER (WHERE m_a < 0.45) AS escalates_a, count(*) FILTER (WHERE m_b < 0.45) AS escalates_b, count(*) FILTER (WHERE (m_a < 0.45) <> (m_b < 0.45)) AS crossings, count(*) FILTER (WHERE m_a < 0.45 AND m_b >= 0.45) AS lost, round(avg(abs(m_b - m_a)), 6) AS mean_shift, round(max(abs(m_b - m_a)), 6) AS most_shift FROM z GROUP BY of""")
def _(s, d):
    """2.13 parser_gate: two arms over the same models, by set and for all."""
    z = _rows(s, d).withColumn("geo_a", (F.col("a") + F.col("q")) % 6).withColumn("geo_b", (F.col("b") + F.col("n")) % 6)
    out = S.arms(z)
    return out.select(*[F.round(c, 6).alias(c) if c.endswith("shift") else F.col(c) for c in out.columns])


@add("gauntlet_methods", f"""WITH {_ROWS}, z AS (SELECT method, size, doc_id, CASE WHEN method = 'vlm' AND n % 9 = 0 THEN NULL WHEN method = 'geometry' THEN a WHEN size = 384 AND method = 'sig' THEN b ELSE (a + b * q) % 6 END AS pick, gold FROM r, (SELECT unnest(['geometry', 'sig', 'ens', 'vlm']) AS method), (SELECT unnest([384, 2048]) AS size)),
y AS (SELECT method, doc_id, count(DISTINCT coalesce(pick, -1)) = 1 AS alike, any_value(pick) FILTER (WHERE size = 2048) AS pick, any_value(gold) AS gold FROM z GROUP BY ALL)
SELECT method, count(*) FILTER (WHERE pick = gold) AS "right", count(*) AS n, count(*) FILTER (WHERE pick IS NULL) AS unanswered, bool_and(alike) AS stable FROM y GROUP BY 1""")
def _(s, d):
    """2.13 gauntlet: every method over all models, and whether the render size changes its picks."""
    z = _rows(s, d).withColumn("method", F.explode(F.array(*map(F.lit, ("geometry", "sig", "ens", "vlm"))))).withColumn("size", F.explode(F.array(F.lit(384), F.lit(2048))))
    pick = F.when((F.col("method") == "vlm") & (F.col("n") % 9 == 0), None).when(F.col("method") == "geometry", F.col("a")).when((F.col("size") == 384) & (F.col("method") == "sig"), F.col("b")).otherwise(((F.col("a") + F.col("b") * F.col("q")) % 6).cast("int"))
    return S.gauntlet(z.select("method", "size", F.col("doc_id").alias("stem"), pick.alias("pick"), "gold"), 2048)


@add("s14_arbiter_picks", """
WITH p AS (SELECT doc_id, n_chars, ['+Z', '-Z', '+Y', '-Y', '+X', '-X'] AS ax FROM documents),
w AS (SELECT 'gemma_sheet256' AS config, doc_id, ax[doc_id % 6 + 1] AS up FROM p WHERE n_chars % 3 > 0 UNION ALL SELECT 'sonnet_sheet512', doc_id, ax[n_chars % 6 + 1] FROM p),
x AS (SELECT 'gemma_sheet256' AS config, doc_id, ax[(doc_id + 1) % 6 + 1] AS up FROM p WHERE doc_id % 10 = 0 AND doc_id % 20 > 0),
u AS (SELECT config, doc_id, up FROM x UNION ALL SELECT config, doc_id, up FROM w WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.config = w.config AND x.doc_id = w.doc_id))
SELECT config, doc_id::VARCHAR AS stem, (list_position(['+Z', '-Z', '+Y', '-Y', '+X', '-X'], up) - 1)::INT AS pick FROM u
""")
def _(s, d):
    """Answers among a prediction's members, by their names and kinds; dumps of later runs take their place, but nulls do not."""
    from polyview.sources.manifests import AXES, arbiter_picks

    p = X.table(s, d, "documents")
    axis = lambda k: F.concat(F.lit('"'), F.element_at(F.array(*map(F.lit, AXES)), (k % 6 + 1).cast("int")), F.lit('"'))
    i, n = F.col("doc_id"), F.col("n_chars")
    gemma = F.when(n % 3 > 0, axis(i)).otherwise(F.when(n % 2 > 0, F.lit("null")).otherwise(F.lit("7")))
    record = F.concat(F.lit('{"geometry": "+Z", "gemma_sheet256": '), gemma, F.lit(', "sonnet_sheet512": '), axis(n), F.lit(', "margin": 0.5}'))
    dump = F.concat(F.lit('{"gemma@256": {"'), i.cast("string"), F.lit('": '), F.when(i % 20 > 0, axis(i + 1)).otherwise("null"), F.lit("}}"))
    return arbiter_picks(p.select(i.cast("string").alias("stem"), record.alias("record")), p.filter(i % 10 == 0).select(dump.alias("json")))


@add("r04_stashed_tiles", """
SELECT t.event_id AS index, t.user_id AS file, e.value AS embedding FROM events t JOIN events e ON e.event_id = t.event_id + 3 WHERE t.event_id % 4 = 0 AND e.ts >= t.ts AND e.ts <= t.ts + INTERVAL 10 MINUTE
""")
def _(s, d):
    """Tiles wait ten minutes for the embeddings of their index."""
    from polyview.streaming.breaker import stashed

    e = X.table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    tiles = e.filter("event_id % 4 = 0").select(F.col("event_id").alias("index"), "ts", F.col("user_id").alias("file"))
    embeds = e.select((F.col("event_id") - 3).alias("index"), "ts", F.col("value").alias("embedding")).filter("index % 4 = 0")
    return stashed(tiles, embeds)


_HITS = f"""{ctes('views', 'texts', 'sims', 'models', 'soft', 'z')}, p AS (SELECT row_id, CASE row_id % 3 WHEN 0 THEN 'z' WHEN 1 THEN 'y' END AS pose FROM mi WHERE row_id % 3 < 2)
SELECT s.text_id, s.rank::INT AS rank, 'm' || s.row_id || '_' || substr(sha1(rel), 1, 6) AS id, '/lib/' || rel AS path, replace(rel, '.stl', '') AS name, round(score, 6) AS score, pose FROM scored s JOIN models m ON m.row_id = s.row_id LEFT JOIN p ON p.row_id = s.row_id WHERE rank <= 5"""


@add("j01_j07_hits", _HITS)
def _(s, d):
    """What a caller sees of each text's best models: key, path, name, and the pose where there is one."""
    from polyview.operators.service import Snapshot, hits

    views, models = X.views(s, d), X.models(s, d)
    poses = views.select("row_id").distinct().filter("row_id % 3 < 2").withColumn("pose", F.when(F.col("row_id") % 3 == 0, "z").otherwise("y"))
    ranked = R.rank(R.robust_z(R.pooled_scores(views, X.texts(s, d))), top=5)
    seen = hits(ranked, Snapshot(views, models, poses, "/lib"), "text_id")
    return seen.select("text_id", F.col("rank").cast("int").alias("rank"), "id", "path", "name", F.round("score", 6).alias("score"), "pose")


@add("k01_l06_result_rows", """
SELECT 'm' || doc_id AS file, CASE WHEN doc_id % 7 = 0 THEN 'RENDER_ERROR: torn ' || lang ELSE lang END AS top1, CASE WHEN doc_id % 7 > 0 THEN n_chars / 100.0::DOUBLE END AS score1, CASE WHEN doc_id % 7 > 0 AND doc_id % 2 = 0 THEN source END AS top2,
  CASE WHEN doc_id % 7 > 0 AND doc_id % 2 = 0 THEN n_chars / 200.0::DOUBLE END AS score2, NULL::VARCHAR AS top3, NULL::DOUBLE AS score3, CASE WHEN doc_id % 7 > 0 THEN '0,0,1' END AS up, CASE WHEN doc_id % 7 > 0 THEN 0.5::DOUBLE END AS pose_conf, CASE WHEN doc_id % 7 > 0 THEN 'geometry' END AS pose_source, CASE WHEN doc_id % 7 > 0 THEN (doc_id % 8)::INT END AS front_view FROM documents
""")
def _(s, d):
    """Rows of the results CSV; a failed model has its error in the place of its first category, and nothing else."""
    from polyview.sources.sinks import result_rows

    i = F.col("doc_id")
    one = F.struct(F.col("lang").alias("category"), (F.col("n_chars") / 100.0).alias("score"))
    two = F.struct(F.col("source").alias("category"), (F.col("n_chars") / 200.0).alias("score"))
    rows = X.table(s, d, "documents").select(i.alias("index"), F.concat(F.lit("m"), i.cast("string")).alias("file"), F.when(i % 7 == 0, F.concat(F.lit("torn "), "lang")).alias("error"), F.when(i % 2 == 0, F.array(one, two)).otherwise(F.array(one)).alias("top"), F.lit("0,0,1").alias("up"), F.lit(0.5).alias("pose_conf"), F.lit("geometry").alias("pose_source"), (i % 8).cast("int").alias("front_view"))
    return result_rows(rows)


@add("k13_l07_times", """
WITH t AS (SELECT page_id, 'd' || page_id % 9 || CASE WHEN page_id % 4 > 0 THEN '/e' || page_id % 5 || '/f' || page_id ELSE '/g' || page_id END AS rel, page_id % 4 = 1 AS is_dir, length(url)::BIGINT AS mtime FROM pages)
SELECT rel, is_dir, mtime, (length(rel) - length(replace(rel, '/', '')) + 1)::INT AS depth FROM t WHERE page_id % 3 > 0 AND mtime <> mtime + page_id % 2
""")
def _(s, d):
    """Times that differ between a tree and its copy, with the depth that orders folders."""
    from polyview.sources.sinks import restore_plan

    i = F.col("page_id")
    text = lambda c: c.cast("string")
    rel = F.concat(F.lit("d"), text(i % 9), F.when(i % 4 > 0, F.concat(F.lit("/e"), text(i % 5), F.lit("/f"), text(i))).otherwise(F.concat(F.lit("/g"), text(i))))
    t = X.table(s, d, "pages").select("page_id", rel.alias("rel"), (i % 4 == 1).alias("is_dir"), F.length("url").cast("long").alias("mtime"))
    return restore_plan(t, t.filter("page_id % 3 > 0").withColumn("mtime", F.col("mtime") + i % 2))
