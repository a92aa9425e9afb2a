"""Evidence: spans and their checks, claim features, support, areas, scope decisions, conflicts, dossiers.

Decisions are single cascades over joined columns: the first rule that holds
gives the status, and the reasons are the names of the rules that spoke.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.functions.text import collapse, first_reason
from lithoframe.operators.dictionary import find_entries, key_words
from lithoframe.operators.graph import closure
from lithoframe.plans.scratch import materialize

#: Cues of claim features in English, as regular expressions without case.
NEGATION = r"\bnot\b|\bno\b|\bnone of\b|\bwithout\b|\black(?:s|ing)? of\b|\babsence of\b"
NOT_NEGATION = r"\bnot only\b|\bno doubt\b|\bno\. ?\d"
HYPOTHESIS = r"\bprobabl|\bpossibl|\blikely\b|\bperhaps\b|\bpresumabl|\bmay (?:be|have)\b|\bmight\b|\bsuggest|\bhypothes"
REPORTED = r"\baccording to\b|\breported by\b|\bet al\b|\(\d{4}\)|\[\d+\]"
QUANTIFIERS = (("ALL", r"\ball\b|\bevery\b|\beach\b|\bentire\b|\bthroughout\b"), ("TYPICAL", r"\btypical|\bcommon(?:ly)?\b|\busual|\bmostly\b|\bgenerally\b"), ("LOCAL", r"\blocal(?:ly)?\b|\brare(?:ly)?\b|\bin places\b|\bsporadic"), ("EXISTS", r"\bfound\b|\bpresent\b|\bobserved\b|\bknown\b|\boccur"))


def evidence_span(df: DataFrame, *, quote: str = "quote", text: str = "text") -> DataFrame:
    """Start and end (code points, end exclusive) of a quote in the collapsed text, and both hashes."""
    plain, q = collapse(F.col(text)), collapse(F.col(quote))
    at = F.call_function("locate", q, plain)
    return df.withColumns({"start": F.when(at > 0, at - 1), "end": F.when(at > 0, at - 1 + F.length(q)), "quote_sha256": F.sha2(q, 256), "text_sha256": F.sha2(plain, 256)})


def verify(text: Column, text_sha256: Column, start: Column, end: Column, quote_sha256: Column) -> Column:
    """Reasons, in order, why stored evidence no longer holds for a text; empty if it does."""
    plain = collapse(text)
    piece = F.substring(plain, start + 1, end - start)
    rules = [
        ("DOCUMENT_MISSING", text.isNull()),
        ("TEXT_HASH_DIFFERS", F.sha2(plain, 256) != text_sha256),
        ("SPAN_MISSING", start.isNull()),
        ("SPAN_OUTSIDE", end > F.length(plain)),
        ("QUOTE_HASH_DIFFERS", F.sha2(piece, 256) != quote_sha256),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for code, test in rules]))


def claim_features(quote: Column) -> dict[str, Column]:
    """polarity, modality and quantifier of a quote."""
    low = F.lower(collapse(quote))
    has = lambda p: F.rlike(low, F.lit(p))
    return {
        "polarity": F.when(has(NEGATION) & ~has(NOT_NEGATION), "NEGATE").otherwise("AFFIRM"),
        "modality": first_reason([("HYPOTHESIS", has(HYPOTHESIS)), ("REPORTED", has(REPORTED))], "ASSERTED"),
        "quantifier": first_reason([(q, has(p)) for q, p in QUANTIFIERS], "UNSPECIFIED"),
    }


def support(valid: Column, ends_named: Column, positional: Column, votes: Column, least: int = 3) -> Column:
    """INVALID_EVIDENCE, UNKNOWN, PARTIAL or ENTAILED; votes count only once the rest holds."""
    return (
        F.when(~valid, "INVALID_EVIDENCE").when(~ends_named, "UNKNOWN").when(positional, "PARTIAL").when(votes.isNull(), "UNKNOWN").when(votes >= least, "ENTAILED").when(votes > 0, "PARTIAL").otherwise("UNKNOWN")
    )


def find_areas(texts: DataFrame, aliases: DataFrame, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, area_id, alias) of every alias that a text names; aliases inside a longer one that the text also names are left out.

    Aliases are compared by their words, up to four of them.
    """
    keyed = aliases.select(F.array_join(key_words(F.lower("alias")), " ").alias("key"), "area_id", "alias")
    return find_entries(texts, keyed, id_col=id_col, text_col=text_col, longest=4).select("id", "area_id", "alias").distinct()


def area_closure(areas: DataFrame) -> DataFrame:
    """(area, ancestor) with every area its own ancestor; ``areas`` has child and parent."""
    own = areas.select(F.explode(F.array("child", "parent")).alias("area")).where("area IS NOT NULL").distinct()
    up = closure(areas.where("parent IS NOT NULL")).select(F.col("child").alias("area"), "ancestor")
    return own.select("area", F.col("area").alias("ancestor")).unionByName(up).distinct()


def area_relation(pairs: DataFrame, known: DataFrame, overlaps: DataFrame | None = None) -> DataFrame:
    """``relation`` of pairs (claim, target): EXACT, PART_OF, CONTAINS, OVERLAP, DISJOINT or UNKNOWN.

    ``known`` is `area_closure`; ``overlaps`` (a, b) are recorded for areas and
    hold for what lies inside them too.
    """
    ids = known.select(F.col("area").alias("__id")).distinct()
    out = pairs.join(ids.withColumnRenamed("__id", "claim").withColumn("__kc", F.lit(True)), "claim", "left").join(ids.withColumnRenamed("__id", "target").withColumn("__kt", F.lit(True)), "target", "left")
    out = out.join(known.select(F.col("area").alias("claim"), F.col("ancestor").alias("target"), F.lit(True).alias("__up")), ["claim", "target"], "left")
    out = out.join(known.select(F.col("area").alias("target"), F.col("ancestor").alias("claim"), F.lit(True).alias("__down")), ["claim", "target"], "left")
    over = F.lit(False)
    if overlaps is not None:
        both = overlaps.select("a", "b").unionByName(overlaps.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        asked = pairs.select("claim", "target").distinct()
        up = asked.join(known.select(F.col("area").alias("claim"), F.col("ancestor").alias("a")), "claim").join(known.select(F.col("area").alias("target"), F.col("ancestor").alias("b")), "target")
        met = up.join(both, ["a", "b"], "left_semi").select("claim", "target", F.lit(True).alias("__over")).distinct()
        out = out.join(met, ["claim", "target"], "left")
        over = F.coalesce("__over", F.lit(False))
    relation = (
        F.when(F.col("__kc").isNull() | F.col("__kt").isNull(), "UNKNOWN").when(F.col("claim") == F.col("target"), "EXACT").when(F.col("__up"), "PART_OF").when(F.col("__down"), "CONTAINS").when(over, "OVERLAP").otherwise("DISJOINT")
    )
    return out.select(*pairs.columns, relation.alias("relation"))


def shared_settings(pairs: DataFrame, known: DataFrame, settings: DataFrame) -> DataFrame:
    """``shared``: settings that both areas, or areas around them, have; ``settings`` has area and setting."""
    held = known.join(settings.withColumnRenamed("area", "ancestor"), "ancestor").groupBy("area").agg(F.array_sort(F.collect_set("setting")).alias("s"))
    a, b = held.select(F.col("area").alias("claim"), F.col("s").alias("__a")), held.select(F.col("area").alias("target"), F.col("s").alias("__b"))
    return pairs.join(a, "claim", "left").join(b, "target", "left").select(*pairs.columns, F.coalesce(F.array_join(F.array_intersect("__a", "__b"), " "), F.lit("")).alias("shared"))


def integrity(areas: DataFrame) -> DataFrame:
    """(area, problem): missing parents and cycles of a hierarchy (child, parent)."""
    known = areas.select(F.col("child").alias("parent")).distinct()
    missing = areas.where("parent IS NOT NULL").join(known, "parent", "left_anti").select(F.col("child").alias("area"), F.lit("MISSING_PARENT").alias("problem"))
    cycles = closure(areas.where("parent IS NOT NULL")).where("child = ancestor").select(F.col("child").alias("area"), F.lit("CYCLE").alias("problem"))
    return missing.unionByName(cycles).distinct()


@dataclass(frozen=True)
class Policy:
    """Which rules of the decision are on; the presets go from none to all."""

    name: str = "full"
    support: bool = True
    region: bool = True
    deposit: bool = True
    polarity: bool = True
    modality: bool = True
    quantifier: bool = True
    stage: bool = True
    mixed: bool = True


POLICIES = {
    "votes": Policy("votes", support=False, region=False, deposit=False, polarity=False, modality=False, quantifier=False, stage=False, mixed=False),
    "region": Policy("region", deposit=True, polarity=False, modality=False, quantifier=False, stage=False, mixed=False),
    "full": Policy(),
}


def decide(policy: Policy) -> tuple[Column, Column]:
    """Status and deciding reason for a row of a question and a claim.

    Columns: support, accepted, target, relation (of the claim's area to the
    target; null for no area), ambiguous, mixed, analogies, shared (true if a
    setting is shared), deposit_ok (null if unknown), polarity, want_polarity,
    modality, want_mode, quantifier, want_quantifier, stage, want_stage,
    conflicting.
    """
    c = F.col
    rules: list[tuple[Column, str, str]] = []
    if policy.support:
        rules += [(c("support") == "INVALID_EVIDENCE", "UNRESOLVED", "SOURCE_HASH_INVALID"), (c("support") != "ENTAILED", "UNRESOLVED", "SUPPORT_NOT_ENTAILED")]
    else:
        rules.append((~c("accepted"), "UNRESOLVED", "LEGACY_CANDIDATE"))
    asked = c("target").isNotNull() if policy.region else F.lit(False)
    if policy.region:
        rules.append((asked & c("relation").isNull(), "UNRESOLVED", "REGION_UNKNOWN"))
        if policy.mixed:
            rules += [(asked & c("mixed"), "UNRESOLVED", "REGION_MIXED"), (asked & c("ambiguous"), "UNRESOLVED", "ALIAS_AMBIGUOUS")]
        for relation, reason in (("CONTAINS", "REGION_CONTAINS_TARGET"), ("OVERLAP", "REGION_OVERLAP"), ("UNKNOWN", "NO_VERIFIED_AREA")):
            rules.append((asked & (c("relation") == relation), "UNRESOLVED", reason))
        away = asked & (c("relation") == "DISJOINT")
        grounded = away & c("analogies") & c("shared") & F.coalesce(c("deposit_ok"), F.lit(False))
        rules += [(grounded, "ANALOG", "GEOLOGICAL_ANALOGY_GROUNDED"), (away & c("analogies"), "OUT_OF_SCOPE", "ANALOGY_NOT_GROUNDED"), (away, "OUT_OF_SCOPE", "REGION_DISJOINT")]
    if policy.deposit:
        rules.append((~c("deposit_ok"), "OUT_OF_SCOPE", "DEPOSIT_TYPE_MISMATCH"))
    if policy.polarity:
        rules.append((c("polarity") != c("want_polarity"), "UNRESOLVED", "POLARITY_MISMATCH"))
    if policy.modality:
        rules.append(((c("modality") == "HYPOTHESIS") & (c("want_mode") != "RESEARCH_REVIEW"), "UNRESOLVED", "MODALITY_HYPOTHESIS"))
    if policy.quantifier:
        whole = ~asked | (c("relation") == "EXACT")
        strong = F.when(c("want_quantifier") == "ALL", c("quantifier") == "ALL").otherwise(c("quantifier").isin("TYPICAL", "ALL"))
        rules.append((c("want_quantifier").isin("TYPICAL", "ALL") & ~(whole & strong), "UNRESOLVED", "SCOPE_UNIVERSALITY_MISMATCH"))
    if policy.stage:
        rules.append((c("want_stage").isNotNull() & ~F.coalesce(F.lower("stage") == F.lower("want_stage"), F.lit(False)), "UNRESOLVED", "TEMPORAL_SCOPE_MISMATCH"))
    rules.append((c("conflicting"), "UNRESOLVED", "CONFLICTING_EVIDENCE"))
    status, reason = F.lit("DIRECT"), F.lit("DIRECT")
    for test, s, r in reversed(rules):
        holds = F.coalesce(test, F.lit(False))
        status, reason = F.when(holds, s).otherwise(status), F.when(holds, r).otherwise(reason)
    return status, reason


def compare_claims(a: str, b: str) -> Column:
    """How two claims on the same ends relate; arguments are aliases with area, stage and polarity."""
    x, y = (lambda n: F.col(f"{a}.{n}")), (lambda n: F.col(f"{b}.{n}"))
    return F.when(x("area") != y("area"), "DIFFERENT_SCOPE").when(x("stage") != y("stage"), "DIFFERENT_STAGE").when(x("polarity") != y("polarity"), "CONFLICT").otherwise("CONSISTENT")


def independent_support(claims: DataFrame) -> DataFrame:
    """Distinct families behind each relation; a long quote that several families share counts for the first.

    ``claims`` has src, relation, dst, family, quote and id.
    """
    shared = Window.partitionBy("quote").orderBy("id")
    own = F.when(F.length("quote") >= 60, F.first("family").over(shared)).otherwise(F.col("family"))
    return claims.withColumn("__f", own).groupBy("src", "relation", "dst").agg(F.count_distinct("__f").alias("families"), F.count("*").alias("claims"))


def dossier(decisions: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Decisions with the section each belongs to; overrides (decision_id, status) move them."""
    out = decisions
    status = F.col("status")
    if overrides is not None:
        out = out.join(overrides.select("decision_id", F.col("status").alias("__new")), "decision_id", "left")
        status = F.coalesce("__new", "status")
    section = F.when(status == "DIRECT", "direct").when(status == "ANALOG", "analogs").when(status == "OUT_OF_SCOPE", "excluded").otherwise("unresolved")
    moved = status != F.col("status")
    return out.withColumns({"section": section, "overridden": moved}).drop("__new")


def kept_sources(sources: DataFrame) -> DataFrame:
    """Sources (question, n, relations) without those all of whose areas are disjoint to the target; renumbered."""
    foreign = (F.size("relations") > 0) & F.forall("relations", lambda r: r == "DISJOINT")
    return sources.where(~foreign).withColumn("place", F.row_number().over(Window.partitionBy("question").orderBy("n")))


def cite_by_numbers(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims (id, numbers) with the only source (source, numbers) that holds all their numbers, if it is one.

    Claims of equal numbers are looked up once, by the number that fewest sources hold;
    a claim of one number is decided by how many hold it.
    """
    held = materialize(sources.select("source", F.explode("numbers").alias("x")).distinct(), "held")
    sets = materialize(claims.where(F.size("numbers") > 0).select("id", F.array_sort(F.array_distinct("numbers")).alias("wanted")), "wanted")
    kinds = materialize(sets.select("wanted").distinct().withColumn("k", F.monotonically_increasing_id()), "kinds")
    each = kinds.select("k", F.size("wanted").alias("n"), F.explode("wanted").alias("x"))
    holders = held.groupBy("x").agg(F.count("*").alias("f"), F.min("source").alias("least"))
    rarest = each.join(holders, "x").groupBy("k", "n").agg(F.count("*").alias("known"), F.min_by(F.struct("x", "f", "least"), F.struct("f", "x")).alias("r"))
    rarest = materialize(rarest.where("known = n").select("k", "n", "r.*"), "rarest")
    near = rarest.where("n > 1").select("k", "n", "x").join(held, "x").select("k", "n", "source")
    full = near.join(each.select("k", "x"), "k").join(held, ["source", "x"]).groupBy("k", "n", "source").agg(F.count("*").alias("c")).where("c = n")
    one = full.groupBy("k").agg(F.min("source").alias("source"), F.count("*").alias("f")).where("f = 1").select("k", "source")
    one = one.unionByName(rarest.where("n = 1 AND f = 1").select("k", F.col("least").alias("source")))
    return sets.join(kinds.join(one, "k").select("wanted", "source"), "wanted").select("id", "source")
