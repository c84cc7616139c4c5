"""Ranked search in catalogs: postings of words, an upper bound on every score, and exact scores where the bound allows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import identifier_words, normalize_identifier, sequence_ratio
from ..sources import scratch

#: How much a score takes from words in an item's text, words in its name, likeness of the names, and words among its tags.
TEXT, NAME, LIKE, TAG = 0.45, 0.25, 0.2, 0.1
#: Scores are rounded to six places, so a bound may be under a score by this.
SLACK = 1e-6
#: So many queries may be broadcast, of about a kilobyte each.
FEW = 10_000
SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _signs(x: Column) -> Column:
    """How often each of SIGNS is in a normalised name."""
    return F.array(*[F.length(x) - F.length(F.replace(x, F.lit(c), F.lit(""))) for c in SIGNS])


def _queries(queries: DataFrame) -> DataFrame:
    q = queries.select("query", *(["family"] if "family" in queries.columns else [])).distinct()
    words = F.array_distinct(identifier_words(F.coalesce("query", F.lit(""))))
    plain = normalize_identifier(F.coalesce("query", F.lit("")))
    q = q.select("query", (F.col("family") if "family" in queries.columns else F.lit(None).cast("string")).alias("q_family"), words.alias("q_words"), plain.alias("q_plain"))
    return q.withColumn("qid", F.xxhash64("query", "q_family")).withColumn("q_signs", _signs(F.col("q_plain")))


def _items(items: DataFrame) -> DataFrame:
    """Items, equal ones as one row with their number in `copies`: they have one score and are told apart by nothing that is given out."""
    tags = F.coalesce("tags", F.array().cast("array<string>")) if "tags" in items.columns else F.array().cast("array<string>")
    text = F.coalesce("text", F.lit("")) if "text" in items.columns else F.col("name")
    family = F.col("family") if "family" in items.columns else F.lit(None).cast("string")
    i = items.where("name IS NOT NULL").select("name", family.alias("family"), text.alias("text"), F.array_sort(F.array_distinct(F.array_compact(tags))).alias("tags"))
    i = i.groupBy("name", "family", "text", "tags").agg(F.count("*").alias("copies"))
    plain = normalize_identifier(F.col("name"))
    i = i.select("name", "family", F.array_distinct(identifier_words(F.col("name"))).alias("name_words"), F.array_distinct(identifier_words(F.col("text"))).alias("text_words"), "tags", plain.alias("plain"), "copies")
    i = i.withColumn("words", F.array_distinct(F.concat("text_words", "name_words", "tags"))).withColumn("signs", _signs(F.col("plain")))
    return _kept(i)


def _kept(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _met(q: DataFrame, i: DataFrame, on: list[str], few: bool) -> DataFrame:
    """q and i joined by equality. Items are never broadcast, whatever their files' size says of them; queries are if they are few."""
    return F.broadcast(q).join(i, on) if few else q.join(i.hint("merge"), on)


def _fits() -> Column:
    return F.col("q_family").isNull() | F.col("q_family").eqNullSafe(F.col("family"))


def _bound() -> Column:
    """No ratio of matching blocks is above this: signs that two names share, twice, by both lengths; 1 where both are empty."""
    both = F.length("q_plain") + F.length("plain")
    shared = F.aggregate(F.zip_with("q_signs", "signs", lambda a, b: F.least(a, b)), F.lit(0), lambda a, x: a + x)
    return F.when(both == 0, 1.0).otherwise(2.0 * shared / both)


def _base() -> Column:
    """What words and tags give to a score; the ratio is still to come. Sums go in the order of the whole formula."""
    n = F.greatest(F.lit(1), F.size("q_words")).cast("double")
    return TEXT * (F.size(F.array_intersect("q_words", "text_words")) / n) + NAME * (F.size(F.array_intersect("q_words", "name_words")) / n)


def _tagged() -> Column:
    return TAG * (F.size(F.array_intersect("q_words", "tags")) / F.greatest(F.lit(1), F.size("q_words")).cast("double"))


def _sharers(q: DataFrame, i: DataFrame, by: str, few: bool) -> DataFrame:
    """Pairs with a word of the array `by` in common, each once: postings of the queries' words meet those of the items' texts, names and tags."""
    asked = q.select("*", F.explode(by).alias("word"))
    held = i.select("*", F.explode("words").alias("word"))
    if not few:  # else items stay where they are
        held = held.join(asked.select("word").distinct(), "word", "left_semi")
    any_family = _met(asked.where("q_family IS NULL"), held, ["word"], few)
    own_family = _met(asked.where("q_family IS NOT NULL").withColumn("family", F.col("q_family")), held, ["word", "family"], few)
    first = F.array_min(F.array_intersect(by, "words"))
    return any_family.unionByName(own_family).where(F.col("word") == first).drop("word")


def _rare(q: DataFrame, i: DataFrame) -> DataFrame:
    """q with `rare`: so many of its words, those that fewest items have, that an item without any of these has no score of `least`.

    Such an item has at most the other words, in its text, in its name and among its tags, of the latter two no more than any item has; its ratio is 1 at most.
    """
    asked = q.select("qid", F.explode("q_words").alias("word"))
    often = i.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("often"))
    ranked = asked.join(often, "word", "left").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "word"))).alias("ranked"))
    longest = i.agg(F.coalesce(F.max(F.size("name_words")), F.lit(0)).alias("most_name"), F.coalesce(F.max(F.size("tags")), F.lit(0)).alias("most_tags"))
    q = q.join(ranked, "qid", "left").crossJoin(F.broadcast(longest))  # one row
    n = F.size("q_words")
    of = F.greatest(F.lit(1), n)
    left = lambda r: TEXT * (n - r) / of + NAME * F.least(n - r, F.col("most_name")) / of + TAG * F.least(n - r, F.col("most_tags")) / of + LIKE
    enough = F.array_min(F.filter(F.sequence(F.lit(0), n), lambda r: left(r) < F.col("least") - SLACK))
    rare = F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.slice("ranked", F.lit(1), F.coalesce(enough, n)), lambda x: x["word"]))
    return q.withColumn("rare", rare).drop("ranked", "most_name", "most_tags")


def _scored(pairs: DataFrame) -> DataFrame:
    """pairs with their score: the one step that needs Python."""
    return pairs.withColumn("score", F.round(_base() + LIKE * sequence_ratio("q_plain", "plain") + _tagged(), 6))


def _at_least(q: DataFrame, i: DataFrame) -> DataFrame:
    """Pairs whose score may be `least` of their query or more, with their scores.

    Pairs that share a word come from postings, of those words only that fewest items have and without one of which no score
    is `least`. Where that is no higher than LIKE, a pair needs no word: such queries look among names of lengths that allow it,
    and by the signs that the names share; queries that share words with many items never meet the others.
    """
    q = _kept(_rare(q, i))
    few = q.count() <= FEW
    likely = _base() + LIKE + _tagged() >= F.col("least") - SLACK
    could = _base() + LIKE * _bound() + _tagged() >= F.col("least") - SLACK
    near = _sharers(q, i, "rare", few).where(likely).where(could)
    lengths = F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("most")))
    # 2 min(a, b) / (a + b) is the most that two lengths allow
    allowed = F.filter(lengths, lambda n: (F.length("q_plain") + n == 0) | (LIKE * 2.0 * F.least(F.length("q_plain"), n) / (F.length("q_plain") + n) >= F.col("least") - SLACK))
    most = i.agg(F.max(F.length("plain")).alias("most"))
    weak = q.where(F.col("least") <= LIKE + SLACK).crossJoin(F.broadcast(most)).withColumn("n", F.explode(allowed)).drop("most")
    far = _met(weak, i.withColumn("n", F.length("plain")), ["n"], few).where(_fits() & ~F.arrays_overlap("rare", "words")).where(could).drop("n")
    return _scored(near.unionByName(far))


def search(queries: DataFrame, items: DataFrame, most: int = 10) -> DataFrame:
    """(query, family, name, score, place): the `most` items of the highest score for each query, exact, ties by name in lower case, then by name.

    queries: query, and family if wanted: only items of that family answer then. items: name, with text (what is said of it, the name
    included; the name where there is no text), tags and family if there are any; an item without a name is none. A score is
    .45 times the share of the query's words that the text has, .25 times the share that the name has, .2 times the ratio of
    matching blocks of the names in lower case without other signs than letters and digits, and .1 times the share that is among the
    tags, to six places. Each row of items is an item. A null query is an empty one; equal queries are one.

    Only pairs that can be among the first are compared by blocks: the score without the ratio is a lower bound, and with a bound
    on the ratio an upper one. The `most`-th lower bound of a query leaves out what cannot reach it.
    """
    q, i = _kept(_queries(queries)), _items(items)
    few = q.count() <= FEW
    # equal lower bounds are counted together before they are shuffled: a query has as many as there are shares
    low = _sharers(q, i, "q_words", few).groupBy("qid", (_base() + _tagged()).alias("low")).agg(F.sum("copies").alias("copies"))
    so_far = F.sum("copies").over(W.partitionBy("qid").orderBy(F.desc("low")))
    least = low.withColumn("at", so_far).where(F.col("at") >= most).groupBy("qid").agg(F.max("low").alias("least"))
    # who shares words with too few takes its bound from a few names of each length, those that look most alike
    q = q.join(least, "qid", "left")
    n = F.length("plain")
    some = i.withColumn("n", n).withColumn("at", F.row_number().over(W.partitionBy("family", "n").orderBy("plain"))).where(F.col("at") <= most).drop("at")
    short = q.where("least IS NULL").drop("least").crossJoin(F.broadcast(i.agg(F.coalesce(F.max(n), F.lit(0)).alias("longest"))))
    short = short.withColumn("n", F.explode(F.sequence(F.lit(0), "longest"))).drop("longest")
    alike = short.join(some, "n").where(_fits()).withColumn("bound", _bound())
    seeds = alike.withColumn("at", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("bound"), "n", "plain"))).where(F.col("at") <= most)
    seeded = _scored(seeds).groupBy("qid").agg(F.when(F.count("*") == most, F.min("score")).alias("seed"))
    q = q.join(seeded, "qid", "left").withColumn("least", F.coalesce("least", "seed", F.lit(0.0))).drop("seed")
    d = _at_least(q, i)
    d = d.groupBy("qid", "query", "q_family", "name", "score").agg(F.sum("copies").alias("copies"))
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), F.lower("name"), "name"))
    d = d.withColumn("place", place).where(F.col("place") <= most).drop("place")
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(most)).cast("int"))))
    return d.withColumn("place", place).where(F.col("place") <= most).select("query", F.col("q_family").alias("family"), "name", "score", "place")


def selected_places(chosen: DataFrame, items: DataFrame) -> DataFrame:
    """chosen (query, selected, family or none) with the score and place, counted from 1 among all items, of the item that is chosen; null if there is none.

    Names are the same if they are so in lower case without other signs than letters and digits; of several the best counts. Only items
    that can stand before it are scored.
    """
    q, i = _queries(chosen.select("query", *(["family"] if "family" in chosen.columns else []))), _items(items)
    plain = normalize_identifier(F.coalesce("selected", F.lit("")))
    wanted = chosen.select(F.xxhash64("query", F.col("family") if "family" in chosen.columns else F.lit(None).cast("string")).alias("qid"), plain.alias("selected_plain")).distinct()
    own = _scored(q.join(wanted, "qid").join(i.hint("merge"), (F.col("selected_plain") == F.col("plain")) & _fits()))
    best = own.groupBy("qid", "selected_plain").agg(F.min(F.struct((-F.col("score")).alias("minus"), F.lower("name").alias("low"), "name")).alias("b"))
    least = best.groupBy("qid").agg(F.min(-F.col("b.minus")).alias("least"))
    better = _at_least(q.join(least, "qid"), i).select("qid", F.struct((-F.col("score")).alias("minus"), F.lower("name").alias("low"), "name").alias("x"), "copies")
    placed = best.join(better, "qid").groupBy("qid", "selected_plain").agg((F.sum(F.when(F.col("x") < F.col("b"), F.col("copies")).otherwise(0)) + 1).alias("place"), (-F.first("b.minus")).alias("score"))
    key = F.xxhash64("query", F.col("family") if "family" in chosen.columns else F.lit(None).cast("string"))
    return chosen.withColumn("qid", key).withColumn("selected_plain", plain).join(placed, ["qid", "selected_plain"], "left").drop("qid", "selected_plain")


def role_errors(roles: DataFrame, tables: DataFrame, columns: DataFrame, most: int = 10) -> DataFrame:
    """roles (role, kind, query, table, selected, type) with place, score and errors.

    kind `table` searches tables (name, text), any other kind the columns (table, name, text, tags, family) of its table, of family `type`
    if that is not null. An error is a table or column that is not there, or one whose place is behind the first `most`.
    """
    r = roles.withColumn("_k", F.monotonically_increasing_id())
    r = r.select("*", normalize_identifier(F.coalesce("table", F.lit(""))).alias("_t"))
    of_table = selected_places(r.where("kind = 'table'"), tables)
    # one catalog for all tables: a column is looked for among those of its table and type
    keyed = columns.select(F.concat_ws(" ", normalize_identifier(F.col("table")), F.coalesce("family", F.lit(""))).alias("typed"), normalize_identifier(F.col("table")).alias("any"), "name", "text", "tags")
    named = keyed.select(F.explode(F.array("typed", F.concat_ws(" ", "any", F.lit("*")))).alias("family"), "name", "text", "tags")
    asked = r.where("kind <> 'table'").withColumn("family", F.concat_ws(" ", "_t", F.coalesce("type", F.lit("*"))))
    of_column = selected_places(asked, named).drop("family")
    known = tables.select(normalize_identifier(F.col("name")).alias("_t")).distinct().withColumn("_known", F.lit(True))
    d = of_table.unionByName(of_column).join(known, "_t", "left")
    late = lambda kind: F.concat(F.lit(f"{kind} role "), "role", F.lit(" selected rank "), F.col("place").cast("string"), F.lit(f" is outside constrained top-{most} candidates"))
    column = F.when(F.col("_known").isNull(), F.concat(F.lit("column role "), "role", F.lit(" missing table "), "table")).when(F.col("place").isNull(), F.concat(F.lit("column role "), "role", F.lit(" missing/incompatible column "), "table", F.lit("."), "selected"))
    error = F.when((F.col("kind") == "table") & F.col("place").isNull(), F.concat(F.lit("table role "), "role", F.lit(" selected missing table "), "selected"))
    error = error.when((F.col("kind") == "table") & (F.col("place") > most), late("table")).when(F.col("kind") != "table", F.coalesce(column, F.when(F.col("place") > most, late("column"))))
    return d.withColumn("errors", F.array_compact(F.array(error))).drop("_k", "_t", "_known")
