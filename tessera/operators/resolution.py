"""Entity resolution: features, candidate pairs, decision cascade, clusters, canonical names, rewriting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..sources.shared import written
from .components import components
from .relations import first_by
from .vectors import similar_pairs, unordered

IS_A = ["is_a", "isa", "type_of"]


def features(triples: DataFrame, order: list[str] = ["pos"]) -> DataFrame:
    """One row for each mention: name, mentions, outgoing and incoming (relation, other) in triple order, relations, neighbours, types, first_seen (the columns of `order`, then 0 as subject and 1 as object)."""
    sides = F.explode(F.array(
        F.struct(F.col("subject").alias("name"), F.lit(0).alias("side"), F.col("relation").alias("relation"), F.col("object").alias("other")),
        F.struct(F.col("object").alias("name"), F.lit(1).alias("side"), F.col("relation").alias("relation"), F.col("subject").alias("other")),
    ))
    rows = triples.select(*order, sides.alias("s")).select(*order, "s.*")
    ordered = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct(*order, "relation", "other")))), lambda x: F.struct(x["relation"].alias("relation"), x["other"].alias("other")))
    return rows.groupBy("name").agg(
        F.count("*").alias("mentions"),
        ordered(0).alias("outgoing"),
        ordered(1).alias("incoming"),
        F.sort_array(F.collect_set("relation")).alias("relations"),
        F.sort_array(F.collect_set("other")).alias("neighbours"),
        F.sort_array(F.collect_set(F.when((F.col("side") == 0) & F.lower("relation").isin(IS_A), F.col("other")))).alias("types"),
        F.min(F.struct(*order, "side")).alias("first_seen"),
    )


def representation(f: DataFrame) -> DataFrame:
    """name and the text that stands for it in similarity search: types and the first 15 facts each way."""
    facts = lambda c, make: F.array_join(F.transform(F.slice(c, 1, 15), make), "\n")
    return f.select("name", "first_seen", F.concat_ws("\n",
        F.concat(F.lit("Entity: "), "name"),
        F.when(F.size("types") > 0, F.concat(F.lit("Possible types: "), F.array_join("types", ", "))),
        F.when(F.size("outgoing") > 0, facts(F.col("outgoing"), lambda x: F.concat_ws(" ", F.lit("->"), x["relation"], x["other"]))),
        F.when(F.size("incoming") > 0, facts(F.col("incoming"), lambda x: F.concat_ws(" ", F.lit("<-"), x["relation"], x["other"]))),
    ).alias("representation"))


def is_parent(a: str, b: str) -> Column:
    """Whether feature struct column a states that it is a kind of b."""
    return F.exists(F.col(f"{a}.outgoing"), lambda x: F.lower(x["relation"]).isin(IS_A) & (T.comparison_form(x["other"]) == T.comparison_form(F.col(f"{b}.name"))))


def specificity_conflict(a: Column, b: Column) -> Column:
    """One name's tokens are a part of the other's, and the shorter name is generic."""
    x, y = T.name_tokens(a), T.name_tokens(b)
    within = lambda s, t: (F.size(F.array_except(s, t)) == 0) & (F.size(s) < F.size(t)) & (F.size(s) > 0)
    return (within(x, y) & T.is_generic(a)) | (within(y, x) & T.is_generic(b))


def compatible(semantic: Column, lexical: Column, token: Column, context: Column) -> Column:
    # Who may be one and the same.
    return ((semantic >= 0.80) & (lexical >= 72)) | ((semantic >= 0.78) & (token >= 0.50)) | ((semantic >= 0.76) & (context >= 0.35)) | (semantic >= 0.88)


def identity_score(semantic: Column, lexical: Column, token: Column, context: Column) -> Column:
    # Weights of the four signals.
    w = [F.lit(x).cast("double") for x in (0.45, 0.25, 0.15, 0.15)]
    return w[0] * semantic + w[1] * lexical / F.lit(100.0) + w[2] * token + w[3] * context


def cascade(pairs: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Pairs with columns x and y (feature structs) and semantic: plus lexical, token, context, combined, reason (of a conflict, else empty), method, merge. The first rule that holds decides; pairs that none decides are borderline."""
    a, b = F.col("x.name"), F.col("y.name")
    out = pairs.withColumn("lexical", T.lexical_ratio(a, b)).withColumn("token", T.token_jaccard(a, b))
    out = out.withColumn("context", T.context_similarity(*[T.jaccard(F.col(f"x.{c}"), F.col(f"y.{c}")) for c in ("relations", "neighbours", "types")]))
    signals = [F.col(c) for c in ("semantic", "lexical", "token", "context")]
    out = out.withColumn("combined", identity_score(*signals))
    x, y = T.comparison_form(a), T.comparison_form(b)
    if aliases is not None:
        known = aliases.select(F.least("long", "short").alias("al_a"), F.greatest("long", "short").alias("al_b")).distinct().withColumn("alias", F.lit(True))
        out = out.join(known, (F.least(x, y) == F.col("al_a")) & (F.greatest(x, y) == F.col("al_b")), "left").drop("al_a", "al_b")
    else:
        out = out.withColumn("alias", F.lit(None).cast("boolean"))
    # Why two names are not one.
    reason = F.when(is_parent("x", "y") | is_parent("y", "x"), "explicit_parent_child_relation").when(specificity_conflict(a, b), "generic_specific_conflict").otherwise("")
    out = out.withColumn("reason", F.when((x == y) | F.coalesce("alias", F.lit(False)), "").otherwise(reason))
    method = (
        F.when(x == y, "exact")
        .when(F.col("alias"), "explicit_alias")
        .when(F.col("reason") != "", "identity_conflict")
        .when(T.acronym_match(a, b) & (F.col("semantic") >= 0.70), "acronym")
        .when((F.col("semantic") >= 0.93) & (F.col("lexical") >= 92) & (F.col("token") >= 0.75), "strong_identity")
        .when(~compatible(*signals), "candidate_blocked")
        .otherwise("borderline")
    )
    return out.withColumn("method", method).withColumn("merge", F.col("method").isin("exact", "explicit_alias", "acronym", "strong_identity")).drop("alias")


def cross_accept(pairs: DataFrame, score: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Borderline pairs by a pair scorer that adds cross_encoder; without one they stay apart as cross_encoder_unavailable."""
    if score is None:
        return pairs.withColumn("cross_encoder", F.lit(None).cast("double")).withColumn("method", F.when(F.col("method") == "borderline", "cross_encoder_unavailable").otherwise(F.col("method")))
    scored = score(pairs.filter("method = 'borderline'"))
    # What the scorer must say.
    yes = (F.col("cross_encoder") >= 0.88) & (F.col("semantic") >= 0.82) & ((F.col("lexical") >= 72) | (F.col("token") >= 0.5) | (F.col("context") >= 0.45)) & (F.col("combined") >= 0.72)
    decided = scored.withColumn("method", F.when(yes, "cross_encoder").otherwise("cross_encoder_rejected")).withColumn("merge", yes)
    return pairs.filter("method <> 'borderline'").withColumn("cross_encoder", F.lit(None).cast("double")).unionByName(decided)


# Who is worth a second look.
WORTH_A_LOOK = "method = 'cross_encoder_rejected' and cross_encoder >= 0.72 and semantic >= 0.80 and (lexical >= 55 or token >= 0.35 or context >= 0.35)"


def review(pairs: DataFrame, verify: Callable[[DataFrame], DataFrame], most: int = 2) -> DataFrame:
    """The `most` best rejected pairs that a verifier (adds same, confidence) may still join; other rows are left out."""
    best = pairs.filter(WORTH_A_LOOK).orderBy(F.desc("combined"), F.desc("cross_encoder"), F.desc("semantic"), "x.first_seen", "y.first_seen").limit(most)
    # Fixed value: how sure the verifier must be.
    return verify(best).withColumn("merge", F.col("same") & (F.col("confidence") >= 0.90)).withColumn("method", F.lit("verifier"))


def canonical_names(f: DataFrame, merges: DataFrame) -> DataFrame:
    """(name, canonical, cluster): clusters of merged pairs (a, b: names), each known by its least name and named by its best member; ties to the first seen."""
    roots = components(merges.select("a", "b")).withColumnRenamed("node", "n_name")
    rows = f.select("name", "mentions", "first_seen").join(roots, F.col("name") == F.col("n_name"), "left").withColumn("cluster", F.coalesce("root", "name"))
    form = T.comparison_form(F.col("name"))
    # What makes a name the one to keep.
    score = F.col("mentions") * 10 + F.least(F.length(form), F.lit(80)) - F.when(F.length(form) <= 2, 20).otherwise(0) - F.when(T.is_generic(F.col("name")), 15).otherwise(0)
    best = rows.groupBy("cluster").agg(F.min_by("name", F.struct((-score).alias("s"), "first_seen")).alias("canonical"))
    return rows.join(best, "cluster").select("name", "canonical", "cluster")


def rewrite(triples: DataFrame, canonical: DataFrame) -> DataFrame:
    """Triples with canonical subject and object."""
    m = canonical.select("name", "canonical")
    out = triples.join(m.select(F.col("name").alias("subject"), F.col("canonical").alias("new_s")), "subject", "left").join(m.select(F.col("name").alias("object"), F.col("canonical").alias("new_o")), "object", "left")
    return out.withColumn("subject", F.coalesce("new_s", "subject")).withColumn("object", F.coalesce("new_o", "object")).select(*triples.columns)


def deduplicate(triples: DataFrame, order: list[str] = ["pos"]) -> DataFrame:
    """The first triple of each comparison form of subject, relation and object."""
    return first_by(triples, [T.comparison_form(F.col(c)) for c in ("subject", "relation", "object")], order)


def resolve(triples: DataFrame, embed: Callable[[DataFrame], DataFrame], texts: DataFrame | None = None, score: Callable | None = None, threshold: float = fixed.CANDIDATE_SIMILARITY, verify: Callable | None = None, order: list[str] = ["pos"]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(resolved triples, canonical map, decisions, features). Empty triples give empty tables. `embed` adds `embedding` to rows with `representation`.

    Entities are known by their names; `order` are the columns that order the
    triples, (doc_id, pos) for several documents. With `verify`, the rejected
    pairs worth a look are left out of the decisions but for those reviewed.
    """
    f = features(triples, order)
    vectors = embed(representation(f)).select(F.col("name").alias("vec_id"), "embedding")
    pairs = unordered(similar_pairs(vectors, threshold=threshold)).withColumnRenamed("similarity", "semantic")
    whole = F.struct(*f.columns)
    x, y = f.select(F.col("name").alias("a"), whole.alias("x")), f.select(F.col("name").alias("b"), whole.alias("y"))
    aliases = texts.select(F.explode(T.alias_pairs(F.col("text"))).alias("p")).select("p.*") if texts is not None else None
    decisions = cross_accept(cascade(pairs.join(x, "a").join(y, "b"), aliases), score)
    if verify is not None:
        reviewed = review(decisions, verify).select(*decisions.columns)
        decisions = decisions.filter(f"not coalesce({WORTH_A_LOOK}, false)").unionByName(reviewed)
    decisions = written(decisions)
    names = canonical_names(f, decisions.filter("merge").select("a", "b"))
    return deduplicate(rewrite(triples, names), order), names, decisions, f


def statistics(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("method").agg(F.count("*").alias("n"), F.sum(F.col("merge").cast("int")).alias("merged"))


def ranked(f: DataFrame) -> DataFrame:
    """Mentions by how often they occur, ties to the first seen."""
    return f.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mentions"), "first_seen")))
