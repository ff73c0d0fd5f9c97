"""Queries of the evaluation and preparation operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termgraph import vocab
from termgraph.operators import dedup, evaluation, relations, search
from termgraph.plans.registry import query, table

S = SparkSession

# gold: the quality label plus twice the toxic one; prediction: by the document's length and language
_ROWS = """rows AS (SELECT l.doc_id, l.quality + 2 * l.toxic AS gold, CASE WHEN d.n_chars % 7 = 0 THEN 3 WHEN d.n_chars > 800 THEN 1 WHEN d.lang = 'en' THEN 0 ELSE 2 END AS pred, d.lang, (d.n_chars % 100) / 100.0 AS conf, l.quality FROM labels l JOIN documents d USING (doc_id))"""
_PRF = "CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn <> 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall"
_F1 = "CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1"


def _rows(spark: S, d: str) -> DataFrame:
    j = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    pred = F.when(F.col("n_chars") % 7 == 0, 3).when(F.col("n_chars") > 800, 1).when(F.col("lang") == "en", 0).otherwise(2)
    return j.select("doc_id", (F.col("quality") + 2 * F.col("toxic")).alias("gold"), pred.alias("pred"), "lang", ((F.col("n_chars") % 100) / 100.0).alias("conf"), "quality")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names or ("precision", "recall", "f1")})


_OUT = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"
_COUNTS = "sum(CASE WHEN pred <> 0 AND pred = gold THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN pred <> 0 AND pred <> gold THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN gold <> 0 AND pred <> gold THEN 1 ELSE 0 END)::BIGINT AS fn"


@query(f"WITH {_ROWS}, n AS (SELECT {_COUNTS} FROM rows), p AS (SELECT *, {_PRF} FROM n), f AS (SELECT *, {_F1} FROM p) SELECT tp, fp, fn, {_OUT} FROM f")
def micro_f1(spark: S, d: str) -> DataFrame:
    """EVA-1."""
    return _rounded(evaluation.micro_f1(_rows(spark, d)))


@query(f"""WITH {_ROWS}, u AS (SELECT gold AS label, 1 AS support, CASE WHEN pred = gold THEN 1 ELSE 0 END AS tp, 0 AS fp FROM rows WHERE gold <> 0 UNION ALL SELECT pred, 0, 0, 1 FROM rows WHERE pred <> 0 AND pred <> gold),
n AS (SELECT label, sum(support)::BIGINT AS support, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp FROM u GROUP BY label),
p AS (SELECT *, CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN support <> 0 THEN tp / support ELSE 0.0 END AS recall FROM n), f AS (SELECT *, {_F1} FROM p)
SELECT label, support, tp, fp, round(precision, 3) AS precision, round(recall, 3) AS recall, round(f1, 3) AS f1 FROM f ORDER BY support DESC, label LIMIT 15""")
def per_class(spark: S, d: str) -> DataFrame:
    """EVA-2: the classes with most support."""
    return evaluation.per_class(_rows(spark, d))


@query(f"""WITH {_ROWS}, n AS (SELECT lang, gold, count(*) AS n, min(doc_id) AS first FROM rows WHERE doc_id % 2 = 0 AND lang <> 'fr' GROUP BY 1, 2),
best AS (SELECT lang, gold FROM n QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, first) = 1)
SELECT r.doc_id, r.gold, coalesce(b.gold, 0) AS prior FROM rows r LEFT JOIN best b USING (lang)""")
def type_prior(spark: S, d: str) -> DataFrame:
    """EVA-3: the majority label of the same language among the even documents; French isn't in training."""
    r = _rows(spark, d).drop("pred")
    train = r.where("doc_id % 2 = 0 AND lang <> 'fr'")
    return evaluation.type_prior(train, r, ["lang"], "gold", "doc_id").select("doc_id", "gold", F.col("pred").alias("prior"))


@query("""WITH gold AS (SELECT n_nationkey AS id, n_name AS s, r_name AS o FROM nation JOIN region ON r_regionkey = n_regionkey), triples AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN r_name || ' SEA' ELSE n_name END AS subject, CASE WHEN n_nationkey % 3 = 0 THEN 'MOON' WHEN n_nationkey % 2 = 0 THEN 'OLD ' || n_name ELSE r_name END AS object FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT (SELECT count(*) FROM gold g WHERE EXISTS (SELECT 1 FROM triples t WHERE t.id = g.id AND (((contains(subject, s) OR contains(s, subject)) AND (contains(object, o) OR contains(o, object))) OR ((contains(object, s) OR contains(s, object)) AND (contains(subject, o) OR contains(o, subject)))))) AS hit, (SELECT count(*) FROM gold) AS total""")
def connected_share(spark: S, d: str) -> DataFrame:
    """EVA-4."""
    j = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    k = F.col("n_nationkey")
    triples = j.select(k.alias("id"), F.when(k % 2 == 0, F.concat("r_name", F.lit(" SEA"))).otherwise(F.col("n_name")).alias("subject"), F.when(k % 3 == 0, "MOON").when(k % 2 == 0, F.concat(F.lit("OLD "), "n_name")).otherwise(F.col("r_name")).alias("object"))
    return evaluation.connected_share(j.select(k.alias("id"), F.col("n_name").alias("s"), F.col("r_name").alias("o"), F.lit(1).alias("label")), triples)


_PAIRS = """names AS (SELECT DISTINCT p_name, p_type FROM part), cross_ AS (SELECT x.p_name AS a, y.p_name AS b, string_split(x.p_name, ' ')[2] = string_split(y.p_name, ' ')[2] AS pos, levenshtein(x.p_name, y.p_name) AS dist FROM (SELECT DISTINCT p_name FROM names) x, (SELECT DISTINCT p_name FROM names) y WHERE x.p_name < y.p_name)"""


def _pairs(spark: S, d: str) -> DataFrame:
    n = table(spark, d, "part").select("p_name").distinct()
    j = n.select(F.col("p_name").alias("a")).join(n.select(F.col("p_name").alias("b")), F.expr("a < b"))
    last = lambda c: F.get(F.split(c, " "), F.lit(1))
    return j.select("a", "b", (last("a") == last("b")).alias("pos"), F.levenshtein("a", "b").alias("dist"))


@query(f"WITH {_PAIRS}, n AS (SELECT sum(CASE WHEN pos AND dist <= 4 THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN NOT pos AND dist <= 4 THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN pos AND dist > 4 THEN 1 ELSE 0 END)::BIGINT AS fn FROM cross_), p AS (SELECT *, {_PRF} FROM n), f AS (SELECT *, {_F1} FROM p) SELECT tp, fp, fn, {_OUT} FROM f")
def pair_prf(spark: S, d: str) -> DataFrame:
    """EVA-5: pairs in either order, each once."""
    p = _pairs(spark, d)
    flipped = p.where("dist <= 4").select(F.col("b").alias("a"), F.col("a").alias("b"))
    return _rounded(evaluation.pair_prf(p.where("pos").union(p.where("pos")).select("a", "b"), p.where("NOT pos").select("a", "b"), flipped.union(flipped)))


@query(f"WITH {_PAIRS} SELECT count(*) AS residual, round(avg(CASE WHEN dist <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall FROM cross_ WHERE pos AND dist > 3")
def net_value(spark: S, d: str) -> DataFrame:
    """EVA-6."""
    p = _pairs(spark, d).where("pos").select((F.col("dist") <= 3).alias("baseline"), (F.col("dist") <= 5).alias("system"))
    return _rounded(evaluation.net_value(p), "recall")


@query("""WITH r AS (SELECT d.n_chars AS score, l.quality = 1 AS positive FROM labels l JOIN documents d USING (doc_id)),
p AS (SELECT score, count(*) AS n FROM r WHERE positive GROUP BY 1), q AS (SELECT score, count(*) AS n FROM r WHERE NOT positive GROUP BY 1)
SELECT round(sum(p.n * q.n * CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0.0 END) / sum(p.n * q.n), 6) AS auc, (SELECT sum(n)::BIGINT FROM p) AS n_pos, (SELECT sum(n)::BIGINT FROM q) AS n_neg FROM p, q""")
def rank_auc(spark: S, d: str) -> DataFrame:
    """EVA-7."""
    r = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(F.col("n_chars").alias("score"), (F.col("quality") == 1).alias("positive"))
    return evaluation.auc(r).withColumn("auc", F.round("auc", 6))


@query(f"WITH {_ROWS}, t AS (SELECT i / 10.0 AS threshold FROM range(1, 10) r(i)), n AS (SELECT CAST(threshold AS DOUBLE) AS threshold, sum(CASE WHEN quality = 1 AND conf >= threshold THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN quality <> 1 AND conf >= threshold THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN quality = 1 AND conf < threshold THEN 1 ELSE 0 END)::BIGINT AS fn FROM rows, t GROUP BY 1), p AS (SELECT *, {_PRF} FROM n), f AS (SELECT *, {_F1} FROM p) SELECT threshold, tp, fp, fn, {_OUT} FROM f")
def threshold_sweep(spark: S, d: str) -> DataFrame:
    """EVA-8, EVA-14."""
    r = _rows(spark, d).select(F.col("conf").cast("double").alias("score"), (F.col("quality") == 1).alias("positive"))
    t = spark.range(1, 10).select((F.col("id") / 10.0).cast("double").alias("threshold"))
    return _rounded(evaluation.threshold_sweep(r, t))


_RANK = """gold AS (SELECT DISTINCT p_brand AS q, replace(p_type, ' ', '') AS t FROM part WHERE p_size > 40), preds AS (SELECT p_brand AS q, p_type AS term, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS rank FROM part GROUP BY 1, 2),
p AS (SELECT q, rank, (q, replace(term, ' ', '')) IN (SELECT (q, t) FROM gold) AS hit FROM preds WHERE rank <= 15), run AS (SELECT *, sum(hit::INT) OVER (PARTITION BY q ORDER BY rank) AS got FROM p),
per AS (SELECT q, max(CASE WHEN rank = 1 AND hit THEN 1.0 ELSE 0.0 END) AS p1, coalesce(1.0 / min(CASE WHEN hit THEN rank END), 0) AS rr, sum(CASE WHEN hit THEN got / rank ELSE 0 END) AS ap, count(*) AS preds FROM run GROUP BY q),
j AS (SELECT b.q, per.*, (SELECT count(*) FROM gold g WHERE g.q = b.q) AS golds FROM (SELECT DISTINCT p_brand AS q FROM part) b LEFT JOIN per USING (q))"""


@query(f"WITH {_RANK} SELECT round(avg(coalesce(p1, 0)), 6) AS p1, round(avg(coalesce(rr, 0)), 6) AS mrr, round(avg(coalesce(ap / least(greatest(golds, 1), preds), 0)), 6) AS map, count(*) AS n FROM j")
def ranking_scores(spark: S, d: str) -> DataFrame:
    """EVA-9, EVA-12."""
    from pyspark.sql import Window

    part = table(spark, d, "part")
    ranked = part.groupBy(F.col("p_brand").alias("q"), F.col("p_type").alias("term")).agg(F.count(F.lit(1)).alias("n"))
    preds = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("n"), "term")))
    gold = part.where("p_size > 40").select(F.col("p_brand").alias("q"), F.col("p_type").alias("term"))
    return _rounded(evaluation.ranking_scores(part.select(F.col("p_brand").alias("q")), preds, gold), "p1", "mrr", "map")


_HIER = """pred AS (SELECT DISTINCT p_name AS child, string_split(p_name, ' ')[2] AS parent FROM part UNION SELECT DISTINCT p_name, p_type FROM part WHERE p_size > 48), gold AS (SELECT DISTINCT p_name AS child, string_split(p_name, ' ')[2] AS parent FROM part UNION SELECT DISTINCT p_name, p_type FROM part WHERE p_size > 49), closed AS (SELECT * FROM gold UNION SELECT child, 'thing' FROM gold),
c AS (SELECT (SELECT count(*) FROM pred) AS pred, (SELECT count(*) FROM (SELECT * FROM pred INTERSECT SELECT * FROM closed)) AS tp, (SELECT count(*) FROM gold) AS gold, (SELECT count(*) FROM (SELECT * FROM pred INTERSECT SELECT * FROM gold)) AS dtp,
 (SELECT count(*) FROM (SELECT * FROM pred INTERSECT SELECT * FROM closed) WHERE NOT ends_with(child, parent)) AS hp, (SELECT count(*) FROM gold WHERE NOT ends_with(child, parent)) AS hg, (SELECT count(*) FROM (SELECT * FROM pred INTERSECT SELECT * FROM gold) WHERE NOT ends_with(child, parent)) AS htp),
r AS (SELECT *, tp / pred AS precision, dtp / gold AS recall_direct, coalesce(htp / nullif(hp, 0), 0) AS a, coalesce(htp / nullif(hg, 0), 0) AS b FROM c)"""


@query(f"WITH {_HIER} SELECT pred, tp, round(precision, 6) AS precision, round(recall_direct, 6) AS recall_direct, round(2 * precision * recall_direct / (precision + recall_direct), 6) AS f1, round(coalesce(2 * a * b / nullif(a + b, 0), 0), 6) AS hetero_f1 FROM r")
def hierarchy_scores(spark: S, d: str) -> DataFrame:
    """EVA-10."""
    part = table(spark, d, "part")
    ends = part.select(F.col("p_name").alias("child"), F.get(F.split("p_name", " "), F.lit(1)).alias("parent"))
    pick = lambda n: ends.union(part.where(f"p_size > {n}").select("p_name", "p_type")).distinct()
    gold = pick(49)
    return _rounded(evaluation.hierarchy_scores(pick(48), gold, gold.union(gold.select("child", F.lit("thing")))), "precision", "recall_direct", "f1", "hetero_f1")


@query("SELECT sum(CASE WHEN contains(text, 'and') OR contains(text, 'que') THEN 1 ELSE 0 END)::BIGINT AS hit, count(*) AS n FROM documents WHERE text IS NOT NULL")
def substring_oracle(spark: S, d: str) -> DataFrame:
    """EVA-11: documents that contain a term of their gold set."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("q"), "text")
    return evaluation.substring_oracle(docs, docs.select("q", F.explode(F.array(F.lit("and"), F.lit("que"))).alias("term")))


@query(f"""WITH {_ROWS}, k AS (SELECT lang AS block, gold, CASE WHEN conf >= 0.5 THEN pred ELSE 0 END AS pred, conf FROM rows), n AS (SELECT block, count(*) AS n, {_COUNTS}, avg(CASE WHEN conf >= 0.5 THEN 1.0 ELSE 0.0 END) AS coverage, quantile_cont(CAST(conf AS DOUBLE), 0.5) AS median FROM k GROUP BY block),
p AS (SELECT *, {_PRF} FROM n), f AS (SELECT *, {_F1} FROM p) SELECT block, n, tp, fp, fn, round(coverage, 6) AS coverage, round(median, 6) AS median, {_OUT} FROM f""")
def confidence_report(spark: S, d: str) -> DataFrame:
    """EVA-13."""
    r = _rows(spark, d).withColumn("conf", F.col("conf").cast("double"))
    return _rounded(evaluation.confidence_report(r, "lang"), "precision", "recall", "f1", "coverage", "median")


@query(f"WITH {_ROWS} SELECT CAST(floor(conf / 0.05 + 1e-9) AS INT) AS bin, count(*) AS n FROM rows GROUP BY 1")
def confidence_histogram(spark: S, d: str) -> DataFrame:
    """EVA-13: by steps of 0.05."""
    return evaluation.histogram(_rows(spark, d).withColumn("conf", F.col("conf").cast("double")))


@query("SELECT DISTINCT p_name AS a, p_brand || '-' || p_name AS b, 'semantic' AS kind FROM part UNION SELECT DISTINCT p_name, replace(upper(p_name), ' ', '_'), 'surface' FROM part")
def surface_kind(spark: S, d: str) -> DataFrame:
    """EVA-15, DED-6: pairs that differ in separators and case alone."""
    p = table(spark, d, "part")
    pairs = p.select(F.col("p_name").alias("a"), F.concat_ws("-", "p_brand", "p_name").alias("b")).union(p.select("p_name", F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))))).distinct()
    return evaluation.surface_kind(pairs)


@query("""WITH n AS (SELECT DISTINCT p_name AS name, p_brand AS canonical, substr(lower(replace(p_name, ' ', '')), 1, 2) AS pre FROM part)
SELECT x.name AS a, y.name AS b FROM n x JOIN n y ON x.pre = y.pre AND x.name < y.name AND x.canonical <> y.canonical ORDER BY 1, 2 LIMIT 500""")
def hard_negatives(spark: S, d: str) -> DataFrame:
    """EVA-15: like-looking pairs of other meaning, as many as there are positives."""
    return evaluation.hard_negatives(table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("canonical")), 500)


@query("""WITH n AS (SELECT DISTINCT p_name AS name, p_brand AS canonical, substr(lower(replace(p_name, ' ', '')), 1, 2) AS pre FROM part)
SELECT x.name AS a, y.name AS b FROM n x JOIN n y ON x.pre = y.pre AND x.name < y.name AND x.canonical <> y.canonical ORDER BY 1, 2 LIMIT (SELECT count(*) FROM n WHERE name <> canonical)""")
def hard_negatives_balanced(spark: S, d: str) -> DataFrame:
    """EVA-15: as many pairs as the same table has positives (a name and its other canonical name)."""
    names = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("canonical"))
    return evaluation.hard_negatives(names, evaluation.positives(names).count())


@query("SELECT doc_id, CASE WHEN (row_number() OVER (ORDER BY doc_id) - 1) % 4 = 0 THEN 'dev' ELSE 'test' END AS split FROM labels")
def dev_split(spark: S, d: str) -> DataFrame:
    """EVA-16, PREP-7."""
    return evaluation.held_out(table(spark, d, "labels").select("doc_id"), ["doc_id"])


@query(f"WITH {_ROWS} SELECT doc_id, gold FROM rows QUALIFY row_number() OVER (PARTITION BY gold ORDER BY doc_id) <= 8000")
def per_label_cap(spark: S, d: str) -> DataFrame:
    """PREP-2: the first 8000 of each label."""
    return evaluation.cap_per_label(_rows(spark, d), 8000, ["doc_id"], "gold").select("doc_id", "gold")


@query(f"WITH {_ROWS} SELECT doc_id, pred, CAST(conf AS DOUBLE) AS conf FROM rows QUALIFY row_number() OVER (PARTITION BY pred ORDER BY conf DESC, doc_id) <= 2000")
def per_label_top(spark: S, d: str) -> DataFrame:
    """PREP-3: the 2000 surest of each label."""
    r = _rows(spark, d).withColumn("conf", F.col("conf").cast("double"))
    return evaluation.cap_per_label(r, 2000, [F.desc("conf"), "doc_id"], "pred").select("doc_id", "pred", "conf")


@query("""WITH r AS (SELECT doc_id, text, regexp_extract(text, '[A-Z][a-z]+') AS s, regexp_extract(text, '[a-z]+[.]') AS o FROM documents)
SELECT doc_id, CAST(instr(text, s) - 1 AS INT) AS s_start, CAST(instr(text, s) + length(s) - 2 AS INT) AS s_end, CAST(instr(text, o) - 1 AS INT) AS o_start, CAST(instr(text, o) + length(o) - 2 AS INT) AS o_end FROM r WHERE s <> '' AND o <> ''""")
def located_words(spark: S, d: str) -> DataFrame:
    """PREP-4: first places of two words of each document."""
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("sentence"), F.regexp_extract("text", "[A-Z][a-z]+", 0).alias("s"), F.regexp_extract("text", "[a-z]+[.]", 0).alias("o")).where("s <> '' AND o <> ''")
    return evaluation.located(docs).select("doc_id", "s_start", "s_end", "o_start", "o_end")


@query(f"WITH {_ROWS} SELECT doc_id, pred, count(*) AS n FROM rows, range(3) GROUP BY 1, 2")
def replicated_rows(spark: S, d: str) -> DataFrame:
    """PREP-5: every row three times."""
    return evaluation.replicated(_rows(spark, d).select("doc_id", "pred"), 3).groupBy("doc_id", "pred").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)),
p AS (SELECT doc_id, row_number() OVER w AS place, sum((length(text) / 2.0 + 400) / 1000 * 0.005 + 1200 / 2.0 / 1000 * 0.015) OVER (w ROWS UNBOUNDED PRECEDING) + (6000 / 2.0 + 400) / 1000 * 0.005 + 1200 / 2.0 / 1000 * 0.015 AS cost FROM c WINDOW w AS (ORDER BY length(text), doc_id))
SELECT doc_id AS chunk_id, CAST(place AS INT) AS place, place <= floor((SELECT count(*) FROM documents WHERE text IS NOT NULL) * 0.1) AND cost <= 0.9 AS called FROM p""")
def hybrid_cap(spark: S, d: str) -> DataFrame:
    """HYB-1 to HYB-4: documents without a triple, shortest first, under both caps."""
    chunks = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_text"))
    triples = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("chunk_id"))
    lengths = relations.topup_candidates(chunks, triples).select("chunk_id", F.length("chunk_text").alias("chars"))
    return relations.call_plan(lengths, chunks.count(), 0.1, 0.9, chars="chars").select("chunk_id", "place", "called")


@query("""WITH c AS (SELECT doc_id, length(text) AS n, (SELECT count(*) FROM labels l WHERE l.doc_id = d.doc_id) AS r FROM documents d WHERE text IS NOT NULL)
SELECT doc_id AS chunk_id, r AS relations FROM c WHERE r = 0 OR r < n / 400""")
def hybrid_sparse(spark: S, d: str) -> DataFrame:
    """HYB-1, sparse: documents with few triples for their length."""
    chunks = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_text"))
    return relations.topup_candidates(chunks, table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id")), "sparse").select("chunk_id", "relations")


_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


@query(f"SELECT a.vec_id AS id, CAST(count(*) AS BIGINT) AS links, min(b.vec_id) AS least FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND round({_COS}, 6) >= 0.3 GROUP BY 1")
def embedding_links(spark: S, d: str) -> DataFrame:
    """DED-11: how many vectors each one is close to, of all."""
    return search.links(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), 0.3)


_LABELS = ", ".join(f"({i}, '{n}')" for i, n in enumerate(vocab.RELATIONS))
_TYPES = ", ".join(f"('{n}', '{n[:3].upper()}', '{t}')" for n, ts in vocab.OBJECT_TYPES.items() for t in sorted(ts))


@query(f"""WITH labels_(n, label) AS (VALUES {_LABELS}), allowed(label, s, o) AS (VALUES {_TYPES}),
r AS (SELECT vec_id AS id, ['PER', 'ORG', 'LOC'][1 + vec_id % 3] AS s_type, ['PER', 'ORG', 'LOC', 'DAT', 'NOH', 'POH'][1 + vec_id % 6] AS o_type, embedding FROM embeddings),
x AS (SELECT id, s_type, o_type, n, label, embedding[n + 1] AS logit FROM r, labels_)
SELECT id, label FROM x WHERE label = 'no_relation' OR (label, s_type, o_type) IN (SELECT (label, s, o) FROM allowed) QUALIFY row_number() OVER (PARTITION BY id ORDER BY logit DESC, n) = 1""")
def typed_argmax(spark: S, d: str) -> DataFrame:
    """REL-12, REL-13: the best label that the types allow, for every vector's first thirty numbers as logits."""
    pick = lambda names, by: F.get(F.array(*map(F.lit, names)), (F.col("vec_id") % by).cast("int"))
    r = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), pick("PER ORG LOC".split(), 3).alias("s_type"), pick("PER ORG LOC DAT NOH POH".split(), 6).alias("o_type"), F.slice("embedding", 1, 30).alias("logits"))
    return relations.best_allowed(r)


@query(f"WITH {_ROWS} SELECT doc_id, CASE WHEN pred <> 0 THEN pred ELSE gold END AS label FROM rows")
def channel_fallback(spark: S, d: str) -> DataFrame:
    """REL-14."""
    return _rows(spark, d).select("doc_id", relations.first_channel("pred", "gold").alias("label"))
