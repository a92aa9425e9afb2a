"""Queries of the evidence operators.

Areas are customers inside nations inside regions; claims are line items with
their supplier's nation as the area, questions are orders with a nation as target.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lithoframe.functions import text as X
from lithoframe.operators import evidence as E
from lithoframe.plans.catalog import query
from lithoframe.plans.fact_graph import _AREAS, areas
from lithoframe.plans.views import CHUNKS, chunks, table

_CLOSURE = f"""{_AREAS}, up AS (SELECT child AS area, parent AS ancestor FROM areas UNION ALL SELECT u.area, a.parent FROM up u JOIN areas a ON a.child = u.ancestor),
known AS (SELECT area, ancestor FROM up UNION SELECT child, child FROM areas UNION SELECT 'W', 'W')"""
_PAIRS = "pairs AS (SELECT s_suppkey AS id, 'N' || s_nationkey AS claim, CASE s_suppkey % 4 WHEN 0 THEN 'R' || (s_suppkey % 5) WHEN 1 THEN 'N' || (s_suppkey % 25) WHEN 2 THEN 'C' || (s_suppkey % 1500 + 1) ELSE 'Z' || s_suppkey END AS target FROM supplier)"


def _pairs(spark, sf_dir):
    k = F.col("s_suppkey")
    label = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    target = F.when(k % 4 == 0, label("R", k % 5)).when(k % 4 == 1, label("N", k % 25)).when(k % 4 == 2, label("C", k % 1500 + 1)).otherwise(label("Z", k))
    return table(spark, sf_dir, "supplier").select(k.alias("id"), label("N", F.col("s_nationkey")).alias("claim"), target.alias("target"))


_RELATION = f"""WITH RECURSIVE {_CLOSURE}, {_PAIRS}, over_ AS (SELECT 'R0' AS a, 'R1' AS b UNION ALL SELECT 'R1', 'R0'), rel AS (SELECT p.*, CASE WHEN claim NOT IN (SELECT area FROM known) OR target NOT IN (SELECT area FROM known) THEN 'UNKNOWN' WHEN claim = target THEN 'EXACT'
WHEN (claim, target) IN (SELECT area, ancestor FROM known) THEN 'PART_OF' WHEN (target, claim) IN (SELECT area, ancestor FROM known) THEN 'CONTAINS'
WHEN EXISTS (SELECT 1 FROM known x, known y, over_ o WHERE x.area = p.claim AND y.area = p.target AND o.a = x.ancestor AND o.b = y.ancestor) THEN 'OVERLAP' ELSE 'DISJOINT' END AS relation FROM pairs p)"""


def _relations(spark, sf_dir):
    overlaps = spark.createDataFrame([("R0", "R1")], "a string, b string")
    return E.area_relation(_pairs(spark, sf_dir), E.area_closure(areas(spark, sf_dir)), overlaps)


@query(f"{_RELATION} SELECT id, claim, target, relation FROM rel")
def area_relation(spark, sf_dir):
    return _relations(spark, sf_dir)


_SETTINGS = "settings AS (SELECT 'R' || r_regionkey AS area, CASE WHEN r_regionkey % 2 = 0 THEN 'arc' ELSE 'rift' END AS setting FROM region UNION ALL SELECT 'N' || n_nationkey, 'belt' || (n_nationkey % 3) FROM nation)"


@query(
    f"""WITH RECURSIVE {_CLOSURE}, {_PAIRS}, {_SETTINGS}, held AS (SELECT k.area, list_sort(list(DISTINCT s.setting)) AS s FROM known k JOIN settings s ON s.area = k.ancestor GROUP BY k.area)
SELECT p.id, array_to_string(list_sort(list_intersect(a.s, b.s)), ' ') AS shared FROM pairs p LEFT JOIN held a ON a.area = p.claim LEFT JOIN held b ON b.area = p.target"""
)
def shared_settings(spark, sf_dir):
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("area"), F.when(F.col("r_regionkey") % 2 == 0, "arc").otherwise("rift").alias("setting"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("area"), F.concat(F.lit("belt"), (F.col("n_nationkey") % 3).cast("string")).alias("setting"))
    return E.shared_settings(_pairs(spark, sf_dir), E.area_closure(areas(spark, sf_dir)), r.unionByName(n)).select("id", "shared")


@query(
    f"""WITH RECURSIVE {_AREAS}, a AS (SELECT child, parent FROM areas WHERE child NOT LIKE 'C%' AND child <> 'N7' UNION ALL SELECT 'N7', 'nowhere' UNION ALL SELECT 'W', NULL UNION ALL SELECT 'A', 'B' UNION ALL SELECT 'B', 'A'),
up AS (SELECT child, parent AS ancestor FROM a WHERE parent IS NOT NULL UNION SELECT u.child, x.parent FROM up u JOIN a x ON x.child = u.ancestor WHERE x.parent IS NOT NULL)
SELECT child AS area, 'MISSING_PARENT' AS problem FROM a WHERE parent IS NOT NULL AND parent NOT IN (SELECT child FROM a) UNION SELECT child, 'CYCLE' FROM up WHERE child = ancestor"""
)
def hierarchy_integrity(spark, sf_dir):
    broken = spark.createDataFrame([("A", "B"), ("B", "A")], "child string, parent string")
    known = areas(spark, sf_dir).where("child NOT LIKE 'C%' AND child <> 'N7'")
    orphan = spark.createDataFrame([("N7", "nowhere"), ("W", None)], "child string, parent string")
    return E.integrity(known.unionByName(orphan).unionByName(broken))


_CLAIMS = """claims AS (SELECT l.l_orderkey * 8 + l.l_linenumber AS id, CASE WHEN l_tax = 0 THEN 'INVALID_EVIDENCE' WHEN l_quantity < 5 THEN 'PARTIAL' ELSE 'ENTAILED' END AS support, l_quantity > 20 AS accepted,
CASE WHEN l_linenumber = 7 THEN NULL ELSE 'N' || (l_orderkey % 25) END AS target, CASE l_suppkey % 6 WHEN 0 THEN 'EXACT' WHEN 1 THEN 'PART_OF' WHEN 2 THEN 'CONTAINS' WHEN 3 THEN 'OVERLAP' WHEN 4 THEN 'DISJOINT' ELSE NULL END AS relation,
l_partkey % 17 = 0 AS ambiguous, l_partkey % 19 = 0 AS mixed, l_linestatus = 'O' AS analogies, l_suppkey % 4 = 0 AS shared, CASE l_partkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END AS deposit_ok,
CASE WHEN l_returnflag = 'R' THEN 'NEGATE' ELSE 'AFFIRM' END AS polarity, 'AFFIRM' AS want_polarity, CASE WHEN l_discount > 0.07 THEN 'HYPOTHESIS' ELSE 'ASSERTED' END AS modality, CASE WHEN l_linenumber = 1 THEN 'RESEARCH_REVIEW' ELSE 'FACT' END AS want_mode,
CASE WHEN l_quantity > 40 THEN 'ALL' WHEN l_quantity > 25 THEN 'TYPICAL' ELSE 'LOCAL' END AS quantifier, CASE l_linenumber WHEN 2 THEN 'ALL' WHEN 3 THEN 'TYPICAL' ELSE 'ANY' END AS want_quantifier,
CASE WHEN l_linestatus = 'F' THEN 'early' END AS stage, CASE WHEN l_linenumber = 4 THEN 'Early' END AS want_stage, l_discount = 0.01 AS conflicting FROM lineitem l)"""


def _claims(spark, sf_dir):
    c = F.col
    n, s, p = c("l_linenumber"), c("l_suppkey") % 6, c("l_partkey") % 3
    return table(spark, sf_dir, "lineitem").select(
        (c("l_orderkey") * 8 + n).alias("id"),
        F.when(c("l_tax") == 0, "INVALID_EVIDENCE").when(c("l_quantity") < 5, "PARTIAL").otherwise("ENTAILED").alias("support"),
        (c("l_quantity") > 20).alias("accepted"),
        F.when(n != 7, F.concat(F.lit("N"), (c("l_orderkey") % 25).cast("string"))).alias("target"),
        F.when(s == 0, "EXACT").when(s == 1, "PART_OF").when(s == 2, "CONTAINS").when(s == 3, "OVERLAP").when(s == 4, "DISJOINT").alias("relation"),
        (c("l_partkey") % 17 == 0).alias("ambiguous"),
        (c("l_partkey") % 19 == 0).alias("mixed"),
        (c("l_linestatus") == "O").alias("analogies"),
        (c("l_suppkey") % 4 == 0).alias("shared"),
        F.when(p == 0, True).when(p == 1, False).alias("deposit_ok"),
        F.when(c("l_returnflag") == "R", "NEGATE").otherwise("AFFIRM").alias("polarity"),
        F.lit("AFFIRM").alias("want_polarity"),
        F.when(c("l_discount") > 0.07, "HYPOTHESIS").otherwise("ASSERTED").alias("modality"),
        F.when(n == 1, "RESEARCH_REVIEW").otherwise("FACT").alias("want_mode"),
        F.when(c("l_quantity") > 40, "ALL").when(c("l_quantity") > 25, "TYPICAL").otherwise("LOCAL").alias("quantifier"),
        F.when(n == 2, "ALL").when(n == 3, "TYPICAL").otherwise("ANY").alias("want_quantifier"),
        F.when(c("l_linestatus") == "F", "early").alias("stage"),
        F.when(n == 4, "Early").alias("want_stage"),
        (c("l_discount") == 0.01).alias("conflicting"),
    )


_DECIDE = """CASE WHEN support = 'INVALID_EVIDENCE' THEN 'SOURCE_HASH_INVALID' WHEN support <> 'ENTAILED' THEN 'SUPPORT_NOT_ENTAILED'
WHEN target IS NOT NULL AND relation IS NULL THEN 'REGION_UNKNOWN' WHEN target IS NOT NULL AND mixed THEN 'REGION_MIXED' WHEN target IS NOT NULL AND ambiguous THEN 'ALIAS_AMBIGUOUS'
WHEN target IS NOT NULL AND relation = 'CONTAINS' THEN 'REGION_CONTAINS_TARGET' WHEN target IS NOT NULL AND relation = 'OVERLAP' THEN 'REGION_OVERLAP'
WHEN target IS NOT NULL AND relation = 'DISJOINT' AND analogies AND shared AND coalesce(deposit_ok, FALSE) THEN 'GEOLOGICAL_ANALOGY_GROUNDED' WHEN target IS NOT NULL AND relation = 'DISJOINT' AND analogies THEN 'ANALOGY_NOT_GROUNDED' WHEN target IS NOT NULL AND relation = 'DISJOINT' THEN 'REGION_DISJOINT'
WHEN NOT deposit_ok THEN 'DEPOSIT_TYPE_MISMATCH' WHEN polarity <> want_polarity THEN 'POLARITY_MISMATCH' WHEN modality = 'HYPOTHESIS' AND want_mode <> 'RESEARCH_REVIEW' THEN 'MODALITY_HYPOTHESIS'
WHEN want_quantifier = 'ALL' AND NOT ((target IS NULL OR relation = 'EXACT') AND quantifier = 'ALL') OR want_quantifier = 'TYPICAL' AND NOT ((target IS NULL OR relation = 'EXACT') AND quantifier IN ('TYPICAL', 'ALL')) THEN 'SCOPE_UNIVERSALITY_MISMATCH'
WHEN want_stage IS NOT NULL AND NOT coalesce(lower(stage) = lower(want_stage), FALSE) THEN 'TEMPORAL_SCOPE_MISMATCH' WHEN conflicting THEN 'CONFLICTING_EVIDENCE' ELSE 'DIRECT' END"""
_STATUS = "CASE WHEN reason = 'DIRECT' THEN 'DIRECT' WHEN reason = 'GEOLOGICAL_ANALOGY_GROUNDED' THEN 'ANALOG' WHEN reason IN ('ANALOGY_NOT_GROUNDED', 'REGION_DISJOINT', 'DEPOSIT_TYPE_MISMATCH') THEN 'OUT_OF_SCOPE' ELSE 'UNRESOLVED' END"


@query(f"WITH {_CLAIMS}, d AS (SELECT id, {_DECIDE} AS reason FROM claims) SELECT id, {_STATUS} AS status, reason FROM d")
def applicability_decision(spark, sf_dir):
    status, reason = E.decide(E.POLICIES["full"])
    return _claims(spark, sf_dir).select("id", status.alias("status"), reason.alias("reason"))


@query(f"WITH {_CLAIMS} SELECT CASE WHEN NOT accepted THEN 'UNRESOLVED' WHEN conflicting THEN 'UNRESOLVED' ELSE 'DIRECT' END AS status, count(*) AS n FROM claims GROUP BY 1")
def votes_only_decision(spark, sf_dir):
    status, _ = E.decide(E.POLICIES["votes"])
    return _claims(spark, sf_dir).select(status.alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_CLAIMS}, d AS (SELECT id, {_DECIDE} AS reason FROM claims), s AS (SELECT id, {_STATUS} AS status, CASE WHEN id % 50 = 0 THEN 'DIRECT' END AS new FROM d)
SELECT CASE coalesce(new, status) WHEN 'DIRECT' THEN 'direct' WHEN 'ANALOG' THEN 'analogs' WHEN 'OUT_OF_SCOPE' THEN 'excluded' ELSE 'unresolved' END AS section, coalesce(new, status) <> status AS overridden, count(*) AS n FROM s GROUP BY 1, 2"""
)
def dossier_sections(spark, sf_dir):
    status, _ = E.decide(E.POLICIES["full"])
    d = _claims(spark, sf_dir).select(F.col("id").alias("decision_id"), status.alias("status"))
    overrides = d.where("decision_id % 50 = 0").select("decision_id", F.lit("DIRECT").alias("status")).distinct()
    return E.dossier(d, overrides).groupBy("section", "overridden").agg(F.count("*").alias("n"))


_PLAIN = r"trim(regexp_replace({}, '[\s\x{{00a0}}]+', ' ', 'g'))"


@query(
    rf"""WITH {CHUNKS}, q AS (SELECT c.doc_id, c.ord, {_PLAIN.format('c.text')} AS q, {_PLAIN.format('d.text')} AS t FROM chunks c JOIN documents d ON d.doc_id = c.doc_id WHERE c.ord = 1 AND c.n_chars > 10)
SELECT doc_id, CAST(strpos(t, q) - 1 AS INTEGER) AS start, CAST(strpos(t, q) - 1 + length(q) AS INTEGER) AS "end", sha256(q) AS quote_sha256, sha256(t) AS text_sha256 FROM q"""
)
def evidence_spans(spark, sf_dir):
    quotes = chunks(spark, sf_dir).where("ord = 1 AND n_chars > 10").select("doc_id", F.col("text").alias("quote"))
    return E.evidence_span(quotes.join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")).drop("quote", "text")


@query(
    rf"""WITH {CHUNKS}, q AS (SELECT c.doc_id, {_PLAIN.format('c.text')} AS q, {_PLAIN.format('d.text')} AS t FROM chunks c JOIN documents d ON d.doc_id = c.doc_id WHERE c.ord = 1 AND c.n_chars > 10),
e AS (SELECT doc_id, strpos(t, q) - 1 AS s, strpos(t, q) - 1 + length(q) AS e, sha256(q) AS qh, sha256(t) AS th FROM q), now_ AS (SELECT doc_id, {_PLAIN.format("CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 20) ELSE text END")} AS t FROM documents WHERE doc_id % 7 <> 0)
SELECT e.doc_id, CASE WHEN n.t IS NULL THEN 'DOCUMENT_MISSING' ELSE concat_ws(' ', CASE WHEN sha256(n.t) <> e.th THEN 'TEXT_HASH_DIFFERS' END, CASE WHEN e.e > length(n.t) THEN 'SPAN_OUTSIDE' END, CASE WHEN sha256(substr(n.t, e.s + 1, e.e - e.s)) <> e.qh THEN 'QUOTE_HASH_DIFFERS' END) END AS reasons FROM e LEFT JOIN now_ n ON n.doc_id = e.doc_id"""
)
def evidence_verify(spark, sf_dir):
    now = table(spark, sf_dir, "documents").where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 20)).otherwise(F.col("text")).alias("now"))
    stored = evidence_spans(spark, sf_dir).join(now, "doc_id", "left")
    reasons = E.verify(F.col("now"), F.col("text_sha256"), F.col("start"), F.col("end"), F.col("quote_sha256"))
    return stored.select("doc_id", F.array_join(reasons, " ").alias("reasons"))


def _cue(p):
    return f"regexp_matches(l, '{p}')"


@query(
    rf"""WITH t AS (SELECT doc_id, lower({_PLAIN.format('text')}) AS l FROM documents WHERE lang = 'en')
SELECT doc_id, CASE WHEN {_cue(E.NEGATION)} AND NOT {_cue(E.NOT_NEGATION)} THEN 'NEGATE' ELSE 'AFFIRM' END AS polarity, CASE WHEN {_cue(E.HYPOTHESIS)} THEN 'HYPOTHESIS' WHEN {_cue(E.REPORTED)} THEN 'REPORTED' ELSE 'ASSERTED' END AS modality,
CASE {' '.join(f"WHEN {_cue(p)} THEN '{q}'" for q, p in E.QUANTIFIERS)} ELSE 'UNSPECIFIED' END AS quantifier FROM t"""
)
def claim_features(spark, sf_dir):
    f = E.claim_features(F.col("text"))
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", *[c.alias(n) for n, c in f.items()])


@query("SELECT l_orderkey * 8 + l_linenumber AS id, CASE WHEN l_tax = 0 THEN 'INVALID_EVIDENCE' WHEN l_quantity < 5 THEN 'UNKNOWN' WHEN l_discount > 0.08 THEN 'PARTIAL' WHEN l_linenumber = 6 THEN 'UNKNOWN' WHEN l_linenumber >= 3 THEN 'ENTAILED' ELSE 'PARTIAL' END AS label FROM lineitem")
def support_label(spark, sf_dir):
    c = F.col
    label = E.support(c("l_tax") != 0, c("l_quantity") >= 5, c("l_discount") > 0.08, F.when(c("l_linenumber") != 6, c("l_linenumber")))
    return table(spark, sf_dir, "lineitem").select((c("l_orderkey") * 8 + c("l_linenumber")).alias("id"), label.alias("label"))


@query(
    r"""WITH n AS (SELECT n_nationkey AS area_id, n_name AS alias FROM nation), t AS (SELECT o_orderkey AS id, 'from ' || n_name || ' to ' || r_name AS text FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT t.id, n.area_id, n.alias FROM t JOIN n ON contains(' ' || lower(t.text) || ' ', ' ' || lower(n.alias) || ' ') WHERE NOT EXISTS (SELECT 1 FROM n m WHERE length(m.alias) > length(n.alias) AND contains(lower(m.alias), lower(n.alias)) AND contains(' ' || lower(t.text) || ' ', ' ' || lower(m.alias) || ' '))"""
)
def area_aliases(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    names = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")
    texts = table(spark, sf_dir, "orders").join(names, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.concat(F.lit("from "), "n_name", F.lit(" to "), "r_name").alias("text"))
    return E.find_areas(texts, nation.select(F.col("n_nationkey").alias("area_id"), F.col("n_name").alias("alias")))


_PAIRED = "s AS (SELECT l_partkey AS k, l_orderkey * 8 + l_linenumber AS id, l_suppkey % 3 AS area, l_linestatus AS stage, CASE WHEN l_returnflag = 'R' THEN 'NEGATE' ELSE 'AFFIRM' END AS polarity FROM lineitem)"


@query(f"WITH {_PAIRED} SELECT a.id AS id_a, b.id AS id_b, CASE WHEN a.area <> b.area THEN 'DIFFERENT_SCOPE' WHEN a.stage <> b.stage THEN 'DIFFERENT_STAGE' WHEN a.polarity <> b.polarity THEN 'CONFLICT' ELSE 'CONSISTENT' END AS kind FROM s a JOIN s b ON a.k = b.k AND a.id < b.id")
def claim_conflicts(spark, sf_dir):
    c = F.col
    s = table(spark, sf_dir, "lineitem").select(c("l_partkey").alias("k"), (c("l_orderkey") * 8 + c("l_linenumber")).alias("id"), (c("l_suppkey") % 3).alias("area"), c("l_linestatus").alias("stage"), F.when(c("l_returnflag") == "R", "NEGATE").otherwise("AFFIRM").alias("polarity"))
    met = s.alias("a").join(s.alias("b"), (c("a.k") == c("b.k")) & (c("a.id") < c("b.id")))
    return met.select(c("a.id").alias("id_a"), c("b.id").alias("id_b"), E.compare_claims("a", "b").alias("kind"))


_INDEP = "c AS (SELECT l_orderkey * 8 + l_linenumber AS id, 'S' || (l_suppkey % 20) AS src, l_returnflag AS relation, 'P' || (l_partkey % 30) AS dst, l_orderkey % 50 AS family, repeat('quote ', CAST(l_linenumber AS INTEGER) * 3) || (l_partkey % 400) AS quote FROM lineitem)"


@query(f"WITH {_INDEP}, f AS (SELECT *, CASE WHEN length(quote) >= 60 THEN first_value(family) OVER (PARTITION BY quote ORDER BY id) ELSE family END AS fam FROM c) SELECT src, relation, dst, count(DISTINCT fam) AS families, count(*) AS claims FROM f GROUP BY ALL")
def independent_support(spark, sf_dir):
    c = F.col
    claims = table(spark, sf_dir, "lineitem").select(
        (c("l_orderkey") * 8 + c("l_linenumber")).alias("id"), F.concat(F.lit("S"), (c("l_suppkey") % 20).cast("string")).alias("src"), c("l_returnflag").alias("relation"), F.concat(F.lit("P"), (c("l_partkey") % 30).cast("string")).alias("dst"), (c("l_orderkey") % 50).alias("family"),
        F.concat(F.call_function("repeat", F.lit("quote "), (c("l_linenumber") * 3).cast("int")), (c("l_partkey") % 400).cast("string")).alias("quote"),
    )
    return E.independent_support(claims)


@query(f"{_RELATION} SELECT question, n, CAST(row_number() OVER (PARTITION BY question ORDER BY n) AS INTEGER) AS place FROM (SELECT id // 10 AS question, id % 10 AS n FROM rel WHERE relation <> 'DISJOINT')")
def kept_sources(spark, sf_dir):
    s = _relations(spark, sf_dir).select(F.floor(F.col("id") / 10).alias("question"), (F.col("id") % 10).alias("n"), F.array("relation").alias("relations"))
    return E.kept_sources(s).select("question", "n", "place")


@query(
    r"""WITH d AS (SELECT doc_id, list_distinct(list_filter(list_transform(regexp_extract_all(text, '\d+(?:[.,]\d+)?'), lambda x: replace(x, ',', '.')), lambda x: length(replace(x, '.', '')) >= 2)) AS numbers FROM documents),
a AS (SELECT doc_id, len(numbers) AS n, unnest(numbers) AS x FROM d WHERE doc_id % 3 = 0), b AS (SELECT doc_id AS source, unnest(numbers) AS x FROM d WHERE doc_id % 3 <> 0),
f AS (SELECT a.doc_id, a.n, b.source, count(*) AS c FROM a JOIN b USING (x) GROUP BY ALL HAVING count(*) = a.n) SELECT doc_id AS id, min(source) AS source FROM f GROUP BY doc_id HAVING count(*) = 1"""
)
def citations_by_numbers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", X.numbers(F.col("text")).alias("numbers"))
    return E.cite_by_numbers(d.where("doc_id % 3 = 0").withColumnRenamed("doc_id", "id"), d.where("doc_id % 3 <> 0").withColumnRenamed("doc_id", "source"))


