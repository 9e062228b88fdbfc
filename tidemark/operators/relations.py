"""Relations between data sets, merge suggestions, schema drift, and reach and likeness in relation graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import profile as P
from tidemark.operators.merge import TIME_NAMES, TIME_WORDS
from tidemark.operators.sampling import numbered
from tidemark.session import stored

# Words of numeric and categorical names, and of frequencies.
NUMERIC = ("count", "amount", "value", "price", "cost", "rate", "ratio", "percentage", "score", "metric", "quantity")
CATEGORICAL = ("name", "type", "category", "class", "group", "status", "state", "id", "code")
FREQUENCIES = {"hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month", "quarterly": "month", "yearly": "year", "annual": "year"}
# Weights of relation types in a merge's confidence.
TYPE_WEIGHTS = {"schema_match": 3.0, "semantic_similarity": 2.5, "partial_schema_match": 2.0, "temporal_relationship": 1.5}
# Weights of changes; a removed field's is a parameter.
CHANGE_WEIGHTS = {"type_changed": 3.0, "field_added": 0.5, "entropy_spike": 2.0, "kurtosis_shift": 2.0, "cardinality_change": 1.5}


def _any(fields: Column, words: Sequence[str]) -> Column:
    return F.exists(fields, lambda f: F.lower(f).rlike("|".join(words)))


def name_counts(datasets: DataFrame) -> DataFrame:
    """datasets(id, fields array<string>) with the numbers of numeric and categorical names, the time column and the frequency."""
    holds = lambda words: F.size(F.filter("fields", lambda f: F.lower(f).rlike("|".join(words))))
    lower = F.transform("fields", F.lower)
    frequency = F.coalesce(*[F.when(_any(F.col("fields"), [w]), F.lit(v)) for w, v in FREQUENCIES.items()])
    known = F.get(F.array_intersect(F.array(*[F.lit(n) for n in TIME_NAMES]), lower), 0)
    time = F.coalesce(known, F.get(F.filter(lower, lambda f: f.rlike("|".join(TIME_WORDS))), 0))
    return datasets.withColumns({"n_numeric": holds(NUMERIC), "n_categorical": holds(CATEGORICAL), "time_column": time, "frequency": frequency})


def _pairs(datasets: DataFrame) -> DataFrame:
    """Pairs of data sets of one workspace: a catalogue, not their rows."""
    d = name_counts(datasets)
    a = d.select("workspace", *[F.col(c).alias(f"a_{c}") for c in ("id", "fields", "time_column", "frequency")])
    b = d.select("workspace", *[F.col(c).alias(f"b_{c}") for c in ("id", "fields", "time_column", "frequency")])
    return a.join(b, "workspace").where("a_id < b_id")


def relations(datasets: DataFrame) -> DataFrame:
    """workspace, a, b, type, confidence by schema, time columns and time-series fit. datasets(workspace, id, fields)."""
    p = _pairs(datasets)
    la, lb = F.transform("a_fields", F.lower), F.transform("b_fields", F.lower)
    common = F.size(F.filter(lb, lambda f: F.array_contains(F.transform(F.col("a_fields"), F.lower), f)))
    fit = 2.0 * common / (F.size(la) + F.size(lb))
    schema = F.when(common == 0, None).when(fit > 0.8, F.struct(F.lit("schema_match").alias("type"), fit.alias("confidence"))).when(fit > 0.5, F.struct(F.lit("partial_schema_match").alias("type"), (fit * 0.8).alias("confidence"))).otherwise(F.struct(F.lit("weak_schema_match").alias("type"), (fit * 0.6).alias("confidence")))
    timed = F.col("a_time_column").isNotNull() & F.col("b_time_column").isNotNull()
    temporal = F.when(timed, F.struct(F.lit("temporal_relationship").alias("type"), F.lit(0.6).alias("confidence")))
    series = F.when(timed, F.struct(F.lit("timeseries_merge_candidate").alias("type"), (F.when(F.col("a_time_column") == F.col("b_time_column"), 0.9).otherwise(0.7) + F.when(F.col("a_frequency") == F.col("b_frequency"), 0.1).otherwise(0.0)).alias("confidence")))
    each = F.filter(F.array(schema, temporal, series), lambda x: x.isNotNull())
    return p.select("workspace", F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.explode(each).alias("r")).select("workspace", "a", "b", "r.type", "r.confidence")


def best_relation(found: DataFrame) -> DataFrame:
    """The relation of the largest confidence of each pair; ties by type."""
    order = Window.partitionBy("workspace", "a", "b").orderBy(F.desc("confidence"), "type")
    return found.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def common_columns(datasets: DataFrame) -> DataFrame:
    """a, b, column: names of a that equal, or (over 3 letters) hold or are held by, a name of b; _ and case don't count."""
    plain = lambda f: F.lower(F.replace(f, F.lit("_"), F.lit("")))
    near = lambda x, y: (plain(x) == plain(y)) | ((F.length(plain(x)) > 3) & (F.length(plain(y)) > 3) & (F.contains(plain(x), plain(y)) | F.contains(plain(y), plain(x))))
    common = F.filter("a_fields", lambda x: F.exists(F.col("b_fields"), lambda y: near(x, y)))
    return _pairs(datasets).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.explode(common).alias("column"))


def merge_plan(found: DataFrame, datasets: DataFrame) -> DataFrame:
    """Per pair: merge type, expected rows (join 70 %, consolidate 80 % of all) and columns, weighted confidence (.95 at most).
    datasets(id, record_count, field_count)."""
    weight = F.lit(1.0)
    for k, v in TYPE_WEIGHTS.items():
        weight = F.when(F.col("type") == k, v).otherwise(weight)
    is_ = lambda *t: F.bool_or(F.col("type").isin(*t))
    s, sem, t, ts = is_("schema_match", "partial_schema_match"), is_("semantic_similarity"), is_("temporal_relationship"), is_("timeseries_merge_candidate")
    kind = F.when(ts, "join").when(s & sem, "append").when(s, "union").when(sem & t, "join").otherwise("union")
    plan = found.groupBy("a", "b").agg(kind.alias("merge_type"), F.least(F.lit(0.95), F.sum(F.col("confidence") * weight) / F.sum(weight)).alias("confidence"))
    size = lambda side: datasets.select(F.col("id").alias(side), F.col("record_count").alias(f"{side}_n"), F.col("field_count").alias(f"{side}_f"))
    both = plan.join(size("a"), "a").join(size("b"), "b")
    rows = F.col("a_n") + F.col("b_n")
    return both.select("a", "b", "merge_type", "confidence", expected_rows(rows, F.col("merge_type")).alias("rows"), F.greatest("a_f", "b_f").alias("columns"))


def expected_rows(rows: Column, merge_type: Column) -> Column:
    return F.floor(rows * F.when(merge_type == "join", 0.7).when(merge_type == "consolidate", 0.8).otherwise(1.0))


def inclusion(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Distinct child values, those among the parent's, and their share: near 1 for a foreign key."""
    values = child.select(F.col(column).alias("v")).where("v IS NOT NULL").distinct()
    keys = parent.select(F.col(key).alias("v")).where("v IS NOT NULL").distinct().withColumn("hit", F.lit(1))
    return values.join(keys, "v", "left").agg(F.count(F.lit(1)).alias("values"), F.count("hit").alias("found")).withColumn("share", F.coalesce(F.try_divide("found", "values"), F.lit(0.0)))


# --- graphs


def stars(members: DataFrame, group: Sequence[str], node: str) -> DataFrame:
    """a and b, each node of a group with the group's least one: these connect what all pairs of each group would, with a row per member.
    Nodes that are alone in their groups have none, nor have those of groups with a null."""
    known = members.dropna(subset=[*group, node])
    least = known.groupBy(*group).agg(F.min(node).alias("a"))
    return known.join(least, list(group)).where(F.col("a") < F.col(node)).select("a", F.col(node).alias("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node, component (its least node) by least labels with pointer jumping, until nothing changes; edges(a, b), undirected. Rounds
    are checkpointed."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = stored(both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
        new = labels.join(near, "node").select("node", F.least("component", "least").alias("component"))
        jump = new.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = stored(new.join(jump, "component").select("node", F.col("up").alias("component")))
        changed = new.join(labels.withColumnRenamed("component", "old"), "node").where("component <> old").limit(1).count()
        labels = new
        if not changed:
            return labels


def same_groups(members: DataFrame, group: Sequence[str], node: str) -> DataFrame:
    """node, kind (the least of the nodes that are in exactly the same groups), stored: these have the same links, so graphs of a group's
    members need one of each kind. Rows with a null are left out."""
    known = members.dropna(subset=[*group, node]).groupBy(node).agg(F.sort_array(F.collect_set(F.struct(*group))).alias("groups"))
    kinds = known.groupBy("groups").agg(F.min(node).alias("kind"))
    return stored(known.join(kinds, "groups").select(F.col(node).alias("node"), "kind"))


def reached(steps: DataFrame, depths: Sequence[int], weights: DataFrame | None = None) -> DataFrame:
    """node and, for each depth d, reach_d: how many other nodes are within d steps(a, b; both ways).

    All nodes are sources at once, 64 of them (neighbours of one node, where that can be) in the bits of a long. A row says which sources of a
    batch have reached a node; a step is a join with the node's links and a bit_or. Counts are sums of bits, so no table of all reachable
    pairs is made. weights(node, weight): as many nodes as a node stands for, which reach each other; all nodes are named there."""
    steps = stored(steps.where("a <> b").select("a", "b").distinct())
    first = steps.groupBy("a").agg(F.min("b").alias("near"))  # nodes with a neighbour in common come one after the other
    if weights is not None:
        first = weights.select(F.col("node").alias("a")).join(first, "a", "left")
    number = numbered(first.select(F.least("near", "a").alias("near"), "a"), ["near", "a"], "i")
    at = stored(number.select(F.col("a").alias("node"), F.floor(F.col("i") / 64).alias("batch"), F.expr("shiftleft(1L, cast(i % 64 AS int))").alias("bits"), (F.col("i") % 64).cast("int").alias("bit")))
    out, now = at.select("node", "batch", "bit"), at.select("node", "batch", "bits")
    for d in range(1, max(depths) + 1):
        moved = now.join(steps, F.col("node") == F.col("a")).select(F.col("b").alias("node"), "batch", "bits")
        now = stored(now.union(moved).groupBy("node", "batch").agg(F.bit_or("bits").alias("bits")))
        if d in depths:
            met = now.withColumn("weight", F.lit(1)) if weights is None else now.join(weights.select("node", "weight"), "node")
            sums = met.groupBy("batch").agg(F.array(*[F.sum(F.shiftrightunsigned("bits", k).bitwiseAND(1) * F.col("weight")) for k in range(64)]).alias("sums"))
            out = out.join(sums, "batch").withColumn(f"reach_{d}", F.element_at("sums", F.col("bit") + 1) - 1).drop("sums")
    return out.drop("batch", "bit")


def _both_ways(edges: DataFrame, weights: DataFrame | None) -> DataFrame:
    """a, b, effect, weight (how many nodes b stands for) of links in both directions, and those of nodes that stand for several with their like."""
    both = edges.select("a", "b", "effect").union(edges.select("b", "a", "effect"))
    if weights is None:
        return both.withColumn("weight", F.lit(1).cast("long"))
    own = weights.where("weight > 1").select(F.col("node").alias("a"), F.col("node").alias("b"), "effect", (F.col("weight") - 1).alias("weight"))
    return both.join(weights.select(F.col("node").alias("b"), "weight"), "b").select("a", "b", "effect", "weight").union(own)


def blast_radius(edges: DataFrame, least: float = 0.3, depth: int = 3, weights: DataFrame | None = None) -> DataFrame:
    """node, degree, reach within 2 steps, mean |effect|, reach within `depth` steps. edges(a, b, effect), undirected. weights(node, weight,
    effect): as many nodes with the same links as a node stands for, linked with each other by that effect of `least` or more."""
    strong = edges.where(F.abs("effect") >= least)
    both = _both_ways(strong, weights).distinct()
    degree = F.countDistinct("b") if weights is None else F.sum("weight")
    out = both.groupBy(F.col("a").alias("node")).agg(degree.alias("degree"), (F.sum(F.abs("effect") * F.col("weight")) / F.sum("weight")).alias("mean_effect"))
    return out.join(reached(both, sorted({2, depth}), weights), "node")


def twins(edges: DataFrame, least: float = 0.85, weights: DataFrame | None = None) -> DataFrame:
    """Pairs of nodes with like neighbours: ((shared / smaller degree) + (1 - mean difference of effects)) / 2 of `least` or more.

    So 2 * least - 1 of the smaller one's neighbours must be shared: of its neighbours in the order of their degrees, one among the first is.
    Nodes meet on those alone, and hubs come last. edges(a, b, effect), undirected. weights(node, weight, effect), as in blast_radius: then a
    row holds for all pairs of nodes that u and v stand for (u = v: of different ones).
    """
    both = stored(_both_ways(edges, weights))
    degree = stored(both.groupBy("a").agg(F.sum("weight").alias("n")))
    order = Window.partitionBy("a").orderBy("nb", "b").rowsBetween(Window.unboundedPreceding, 0)  # of one node's neighbours
    placed = both.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("n").alias("nb")), "b").withColumn("before", F.sum("weight").over(order) - F.col("weight"))
    placed = stored(placed.select("a", "b", "n", "before"))
    first = placed.where(F.col("before") <= F.col("n") - F.greatest(F.ceil(F.col("n") * (2 * least - 1) - 1e-9), F.lit(1)))
    x, y = first.alias("x"), placed.alias("y")
    met = x.join(y, (F.col("x.b") == F.col("y.b")) & (F.col("x.n") <= F.col("y.n")) & (F.col("x.a") != F.col("y.a")))
    pairs = stored(met.select(F.least("x.a", "y.a").alias("u"), F.greatest("x.a", "y.a").alias("v")).distinct())
    ours = pairs.join(both.select(F.col("a").alias("u"), "b", F.col("effect").alias("eu"), F.col("weight").alias("wu")), "u")
    w = F.least("wu", "wv")  # what u and v stand for is one less among their own neighbours
    shared = ours.join(both.select(F.col("a").alias("v"), "b", F.col("effect").alias("ev"), F.col("weight").alias("wv")), ["v", "b"]).groupBy("u", "v").agg(F.sum(w).alias("shared"), (F.sum(F.abs(F.col("eu") - F.col("ev")) * w) / F.sum(w)).alias("gap"))
    sized = shared.join(degree.select(F.col("a").alias("u"), F.col("n").alias("nu")), "u").join(degree.select(F.col("a").alias("v"), F.col("n").alias("nv")), "v")
    out = sized.select("u", "v", "shared", ((F.col("shared") / F.least("nu", "nv") + 1 - F.col("gap")) / 2).alias("similarity"))
    if weights is not None:
        alone = weights.where("weight > 1").select(F.col("node").alias("a")).join(degree, "a").where("n > 1")
        out = out.union(alone.select(F.col("a").alias("u"), F.col("a").alias("v"), (F.col("n") - 1).alias("shared"), (((F.col("n") - 1) / F.col("n") + 1) / 2).alias("similarity")))
    return out.where(F.col("similarity") >= least)


# --- drift


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """field, type, nullable, distinct, entropy (of values, numbers rounded to whole), mean, std_pop, kurtosis (excess)."""
    types = dict(df.dtypes)
    number = lambda c: types[c] in ("int", "bigint", "double", "float", "smallint", "tinyint") or types[c].startswith("decimal")
    plain = df.select(*[(F.round(F.col(c).cast("double")).cast("string") if number(c) else F.col(c).cast("string")).alias(c) for c in columns])
    freq = P.frequencies(plain, columns)
    spread = F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")
    entropy = freq.groupBy("field").agg(F.when(F.count(F.lit(1)) == 1, 0.0).otherwise(spread).alias("entropy"))
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(c).cast("double") if number(c) else F.lit(None).cast("double")
        aggs += [F.countDistinct(c).alias(f"d{i}"), F.bool_or(F.col(c).isNull()).alias(f"u{i}"), F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}"), F.kurtosis(v).alias(f"k{i}")]
    row = df.agg(*aggs)
    kind = lambda c: "numeric" if number(c) else "boolean" if types[c] == "boolean" else "string" if types[c] == "string" else types[c]
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.lit(kind(c)).alias("type"), F.col(f"u{i}").alias("nullable"), F.col(f"d{i}").alias("distinct"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std_pop"), F.col(f"k{i}").alias("kurtosis")) for i, c in enumerate(columns)])
    return row.select(F.explode(each).alias("f")).select("f.*").join(entropy, "field", "left")


def drift(baseline: DataFrame, current: DataFrame, entropy: float = 0.3, kurtosis: float = 2.0, distinct: float = 0.5) -> DataFrame:
    """field, change, severity (1 low to 3 high) of two fingerprints; a change of type hides a field's other changes."""
    name = lambda f, s: f.select("field", *[F.col(c).alias(f"{s}_{c}") for c in ("type", "entropy", "kurtosis", "distinct")])
    both = name(baseline, "a").join(name(current, "b"), "field", "full")
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    one = lambda change, severity: F.struct(F.lit(change).alias("change"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"))
    moved = F.when(a("entropy") == 0, b("entropy") > entropy).otherwise(F.abs(b("entropy") - a("entropy")) / F.when(a("entropy") != 0, a("entropy")) > entropy)
    spread = F.when(a("distinct") == 0, b("distinct") > 10).otherwise(F.abs(b("distinct") - a("distinct")) / F.when(a("distinct") != 0, a("distinct")) > distinct)
    pair = F.array_sort(F.array(a("type"), b("type")))
    typed = F.when(pair == F.array(F.lit("float"), F.lit("int")), 1).when(pair == F.array(F.lit("numeric"), F.lit("string")), 2).otherwise(3)
    changes = F.when(b("type").isNull(), F.array(one("field_removed", 3))).when(a("type").isNull(), F.array(one("field_added", 1))).when(a("type") != b("type"), F.array(one("type_changed", typed))).otherwise(
        F.filter(F.array(F.when(moved, one("entropy_spike", 2)), F.when(F.abs(b("kurtosis") - a("kurtosis")) > kurtosis, one("kurtosis_shift", 2)), F.when(spread, one("cardinality_change", 1))), lambda x: x.isNotNull())
    )
    return both.select("field", F.explode(changes).alias("c")).select("field", "c.change", "c.severity")


def drift_summary(changes: DataFrame, removal: float = 5.0) -> DataFrame:
    """Changes, severity (the largest), impact (0 to 1; each severity weighed by its kind of change), handled, quarantined."""
    weight = F.when(F.col("change") == "field_removed", removal)
    for change, w in CHANGE_WEIGHTS.items():
        weight = weight.when(F.col("change") == change, w)
    weight = weight.otherwise(1.0)
    s = changes.agg(F.count(F.lit(1)).alias("changes"), F.coalesce(F.max("severity"), F.lit(0)).alias("severity"), F.coalesce(F.sum(F.col("severity") * weight), F.lit(0.0)).alias("total"))
    return s.select("changes", "severity", F.coalesce(F.least(F.lit(1.0), F.try_divide("total", F.col("changes") * 4 * removal)), F.lit(0.0)).alias("impact"), (F.col("severity") >= 2).alias("handled"), (F.col("severity") >= 3).alias("quarantined"))
