"""Registered queries of the graph operators.

Most run on the co-activity graph of the events (users with events of one type
in the same hours) with the fixed partition user_id mod R. Costs are rounded
before they are compared, ties go to the smaller id, results are rounded to six
places, so that float order cannot change them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions.scalars import guarded, mean_sd, negative_part, positive_part, quartic_minimum, shown, spectral_angle
from lamella.operators import blocks, consensus, edges, factors, generate, linear, metrics, packed, pairs, statistics, sweep, windows
from lamella.operators.incidence import Incidence
from lamella.plans import exact, experiments, fit, methods
from lamella.plans.lineage import cut, shared_dir
from lamella.sources import graphs, sinks

Query = Callable[[SparkSession, str], DataFrame]

#: Communities of the fixed partition.
R = 5


class Graph:
    """The co-activity graph of the events; its edges are made when they are first asked for.

    kept: graphs by application and folder, for sessions that run many queries on
    one; None: every query makes its own.
    """

    kept: dict[tuple[str, str], Graph] | None = None

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Graph:
        if cls.kept is None:
            return cls(spark, sf_dir)
        return cls.kept.setdefault((spark.sparkContext.applicationId, sf_dir), cls(spark, sf_dir))

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.nodes = graphs.users(spark, sf_dir)
        self.part = self.nodes.select("node", (F.col("node") % R).cast("int").alias("c"))

    @cached_property
    def edges(self) -> DataFrame:
        return cut(graphs.coactivity(self.spark, self.sf_dir))

    @cached_property
    def shared(self) -> Incidence:
        """The same graph without its edges."""
        return Incidence(graphs.activity(self.spark, self.sf_dir))

    @cached_property
    def layers(self) -> list[str]:
        """The types of events: one row for each comes to the driver."""
        rows = graphs.read(self.spark, self.sf_dir, "events").filter("user_id is not null").select("event_type").distinct().collect()
        return sorted(r.event_type for r in rows)

    @cached_property
    def n(self) -> int:
        return self.nodes.count()

    @property
    def weights(self) -> DataFrame:
        return blocks.unit_weights(blocks.degree_share(self.shared, self.part, self.nodes, self.layers))

    def state(self) -> tuple[DataFrame, DataFrame]:
        w = cut(self.weights)
        return w, cut(blocks.block_sums(self.shared, w))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: shown(F.col(c)) for c in columns})


def on_graph(f: Callable[[Graph], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(Graph.of(spark, sf_dir))


def by_cell(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(F.col(n).cast("long").alias(n) if n in ("p", "q", "c", "k", "rank", "n") else F.col(n) for n in names))


def noise(node: Column, salt: str) -> Column:
    return generate.uniform(F.lit(salt), node)


def deg_by_layer(g: Graph) -> DataFrame:
    return rounded(edges.degrees(g.shared, g.nodes, g.layers), "deg")


def layer_norm(g: Graph) -> DataFrame:
    return rounded(edges.norms(g.shared).select("layer", F.sqrt("norm2").alias("norm")), "norm")


def layer_stats(g: Graph) -> DataFrame:
    out = statistics.layer_statistics(g.shared, g.n, g.layers)
    return rounded(out, *(c for c in out.columns if c != "layer"))


def layer_summary(g: Graph) -> DataFrame:
    return rounded(statistics.across_layers(statistics.layer_statistics(g.shared, g.n, g.layers)), "mean", "sd")


def layer_table(g: Graph) -> DataFrame:
    """All statistics of each layer, as text."""
    every = statistics.multilayer_properties(g.shared, g.nodes, g.layers)
    return every.select("layer", "components", mean_sd(F.col("avg_degree"), F.col("degree_sd")).alias("degree"), shown(F.col("clustering")).alias("clustering"))


def mean_similarity(g: Graph) -> DataFrame:
    return rounded(statistics.mean_similarity(statistics.layer_similarity(g.shared, g.n)), "similarity")


def upper_weight(g: Graph) -> DataFrame:
    return edges.upper(g.edges).groupBy("layer").agg(shown(F.sum("weight")).alias("weight"))


def block_density(g: Graph) -> DataFrame:
    return by_cell(rounded(blocks.block_density(g.edges, g.part), "density"), "layer", "p", "q", "density")


def largest_rows(g: Graph) -> DataFrame:
    return rounded(linear.largest_rows(edges.layer_sum(g.edges), 10), "norm2")


def column_means(g: Graph) -> DataFrame:
    """Mean and median of the columns of the nodes whose remainder by 3 is 0."""
    return rounded(pairs.column_averages(g.shared, g.nodes.filter("node % 3 = 0").select(F.col("node").alias("column"))), "mean", "median")


def expected_adjacency(g: Graph) -> DataFrame:
    """X D X' on the cells of the sum of the layers, where D is -1 for the last column."""
    return pairs.expected_adjacency(g.shared, factor(g), [-1.0 if k == R - 1 else 1.0 for k in range(R)])


def matrix_distance(g: Graph) -> DataFrame:
    """Sum of the differences of the cells of the first two layers."""
    a, b = (g.edges.filter(F.col("layer") == x) for x in g.layers[:2])
    return rounded(linear.absolute_distance(a, b), "distance")


def matched_columns(g: Graph) -> DataFrame:
    """The columns of a factor against those of the same factor, shifted by one and with some noise."""
    h = cut(factor(g).filter("k < 3"))
    other = h.select("node", ((F.col("k") + 1) % 3).cast("int").alias("k"), (F.col("value") + 0.1 * generate.uniform(F.lit("e"), F.col("node"), F.col("k"))).alias("value"))
    found = linear.matched_columns(h, cut(other), 3)
    return found.select(F.col("k").cast("long").alias("k"), F.col("j").cast("long").alias("j"), shown(F.col("angle")).alias("angle"))


def large_values(g: Graph) -> DataFrame:
    """The nodes whose centred weight is as large in size as the tenth."""
    centred = g.nodes.select("node", F.round(noise(F.col("node"), "v") - 0.5, 9).alias("value"))
    return rounded(linear.above(centred, 10), "value")


def parts_of(g: Graph) -> DataFrame:
    """Positive and negative parts, and guarded values, of centred numbers."""
    x = F.round(noise(F.col("node"), "v") - 0.5, 6)
    return g.nodes.select("node", positive_part(x).alias("positive"), (negative_part(x) + F.lit(0.0)).alias("negative"), guarded(x / F.nullif(F.col("node") % 3, F.lit(0))).alias("guarded"))


def elbows(g: Graph) -> DataFrame:
    found = windows.elbows(edges.degrees(g.shared).withColumnRenamed("deg", "value"), 2)
    return found.select("layer", F.col("number").cast("long").alias("number"), F.col("q").cast("long").alias("q"))


def transitivity(g: Graph) -> DataFrame:
    return rounded(statistics.transitivity(g.shared), "clustering")


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = Incidence(graphs.daily_activity(spark, sf_dir)), graphs.users(spark, sf_dir)
    return statistics.component_counts(e, edges.everywhere(n, e.layers))


def layer_similarity(g: Graph) -> DataFrame:
    return rounded(statistics.layer_similarity(g.shared, g.n), "similarity")


def sum_graph(g: Graph) -> DataFrame:
    return rounded(edges.layer_sum(g.edges), "weight")


def mean_graph(g: Graph) -> DataFrame:
    return rounded(edges.layer_mean(g.edges, len(g.layers)), "weight")


def symmetrize_binarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = graphs.trade(spark, sf_dir)
    both = edges.symmetrized(e).select("layer", "src", "dst", "weight")
    ones = edges.binarized(edges.without_loops(edges.clamped(both.withColumn("weight", F.col("weight") - 40)))).withColumnRenamed("weight", "heavy")
    return both.join(ones, ["layer", "src", "dst"], "left").select("layer", "src", "dst", "weight", F.coalesce("heavy", F.lit(0.0)).alias("heavy"))


def norm_adj_tau(g: Graph) -> DataFrame:
    return pairs.normalized(g.shared, g.n)


def diag_augmented(g: Graph) -> DataFrame:
    return rounded(edges.augmented(g.edges, g.n).filter("src = dst"), "weight")


def bias_adjusted_square(g: Graph) -> DataFrame:
    return rounded(pairs.squared_without_degrees(g.shared), "weight")


def community_mass(g: Graph) -> DataFrame:
    return by_cell(rounded(blocks.community_mass(g.shared, g.part), "mass"), "layer", "c", "mass")


def degree_share(g: Graph) -> DataFrame:
    return by_cell(rounded(blocks.degree_share(g.shared, g.part, g.nodes, g.layers), "w"), "layer", "node", "c", "w")


def unit_weights(g: Graph) -> DataFrame:
    return by_cell(rounded(g.weights, "w"), "layer", "node", "c", "w")


def block_sum_s(g: Graph) -> DataFrame:
    return by_cell(rounded(g.state()[1], "s"), "layer", "p", "q", "s")


def block_mean_b(g: Graph) -> DataFrame:
    return by_cell(rounded(blocks.block_means(g.edges, g.part), "b"), "layer", "p", "q", "b")


def block_normalized(g: Graph) -> DataFrame:
    return by_cell(rounded(blocks.normalized_blocks(blocks.block_means(g.edges, g.part)), "b"), "layer", "p", "q", "b")


def degree_correction(g: Graph) -> DataFrame:
    theta = blocks.degree_corrections(g.edges, g.part, g.nodes, g.layers)
    normal = blocks.normalized_corrections(theta, blocks.block_means(g.edges, g.part)).withColumnRenamed("theta", "theta_normalized")
    return by_cell(rounded(theta.join(normal, ["layer", "node", "c"]), "theta", "theta_normalized"), "layer", "node", "c", "theta", "theta_normalized")


def recon_error(g: Graph) -> DataFrame:
    return rounded(blocks.reconstruction(g.shared, g.state()[1]), "norm2", "s2", "error")


def sweep_coeffs(g: Graph) -> DataFrame:
    w, s = g.state()
    return by_cell(rounded(sweep.coefficients(g.shared, w, s, R), "a4", "c1", "c0"), "layer", "node", "k", "a4", "c1", "c0")


def quartic(g: Graph) -> DataFrame:
    w, s = g.state()
    c = sweep.coefficients(g.shared, w, s, R).withColumn("a", 4 * F.col("a4")).withColumn("c", 2 * F.col("c1"))
    return by_cell(rounded(quartic_minimum(c, "a", "c", "c0"), "x", "f"), "layer", "node", "k", "x", "f")


def sweep_assign(g: Graph) -> DataFrame:
    w, s = g.state()
    return by_cell(rounded(sweep.moves(sweep.coefficients(g.shared, w, s, R), g.nodes), "cost"), "node", "c", "cost")


def sweep_assign_shared(g: Graph) -> DataFrame:
    w, s = g.state()
    return by_cell(rounded(sweep.moves(sweep.coefficients(g.shared, w, s, R, shared=True), g.nodes), "cost"), "node", "c", "cost")


def sweep_error(g: Graph) -> DataFrame:
    w, s = g.state()
    moved = cut(sweep.moves(sweep.coefficients(g.shared, w, s, R), g.nodes))
    after = cut(blocks.unit_weights(sweep.moved_weights(moved, g.layers)))
    return rounded(blocks.relative_error(blocks.reconstruction(g.shared, blocks.block_sums(g.shared, after))), "error")


def modularity(g: Graph) -> DataFrame:
    return rounded(metrics.modularity(g.edges, g.part).select("layer", F.col("c").cast("long").alias("c"), "q"), "q")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two partitions of the customers: their nation mod 5 (none for nation 7) and a part of their market segments."""
    c = graphs.read(spark, sf_dir, "customer")
    return c.select(F.when(F.col("c_nationkey") != 7, F.col("c_nationkey") % 5).cast("long").alias("a"), ((F.col("c_nationkey") + F.length("c_mktsegment")) % 5).cast("long").alias("b"))


def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.contingency(labels(spark, sf_dir))


def nmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.agreement(labels(spark, sf_dir)).select("nmi", "nmi_geometric"), "nmi", "nmi_geometric")


def ari(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.agreement(labels(spark, sf_dir)).select("ari"), "ari")


def misclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.misclassified(labels(spark, sf_dir)), "error")


def knn_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = graphs.nearest_by_cosine(graphs.read(spark, sf_dir, "embeddings"), 20)
    return near.select("src", "dst", F.col("rank").cast("long").alias("rank"))


def knn_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = graphs.nearest_by_cosine(graphs.read(spark, sf_dir, "embeddings"), 20).select(F.lit("similar").alias("layer"), "src", "dst", F.lit(1.0).alias("weight"))
    return edges.symmetrized(near, "max").groupBy("src").agg(F.count(F.lit(1)).alias("n"))


def mean_removed_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The angle of every vector with the next one."""
    v = graphs.read(spark, sf_dir, "embeddings")
    a, b = v.select(F.col("vec_id").alias("a"), F.col("embedding").alias("va")), v.select((F.col("vec_id") - 1).alias("a"), F.col("embedding").alias("vb"))
    return rounded(a.join(b, "a").select("a", spectral_angle(F.col("va"), F.col("vb")).alias("angle")), "angle")


def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.numbered(graphs.read(spark, sf_dir, "part").select(F.col("p_name").alias("node")))


def contact_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contact log of the events: users with the type's user of the same number by ten."""
    e = graphs.read(spark, sf_dir, "events").filter("user_id is not null")
    log = e.select(F.unix_timestamp("ts").cast("double").alias("time"), F.col("user_id").cast("string").alias("id1"), F.floor(F.col("user_id") / 10).cast("string").alias("id2"))
    ids = log.select(F.col("id1").alias("id")).unionAll(log.select("id2")).distinct()
    people = ids.withColumn("class", F.when(F.col("id").cast("long") % 4 == 0, " Teachers ").otherwise(F.concat(F.lit("c"), F.col("id").cast("long") % 4))).withColumn("gender", F.lit("u"))
    found, nodes = graphs.contact_layers(log, people, "UTC")
    named = nodes.select("node_id", "name", "label")
    a, b = named.select(F.col("node_id").alias("src"), F.col("name").alias("a"), F.col("label").cast("long").alias("la")), named.select(F.col("node_id").alias("dst"), F.col("name").alias("b"), F.col("label").cast("long").alias("lb"))
    return found.join(a, "src").join(b, "dst").select("layer", "a", "b", "la", "lb", "weight")


def citation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of three labels as papers; each cites the one whose id is half of its own."""
    v = graphs.read(spark, sf_dir, "embeddings")
    papers = v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"), F.col("label").cast("string").alias("class"))
    cites = v.select(F.floor(F.col("vec_id") / 2).alias("cited"), F.col("vec_id").alias("citing"))
    found, nodes = graphs.citation_layers(papers, cites, ["1", "2", "5"], 5)
    name = nodes.select("node_id", F.col("name").cast("long").alias("id"), F.col("label").cast("long").alias("label"))
    a, b = name.select(F.col("node_id").alias("src"), F.col("id").alias("a"), F.col("label").alias("la")), name.select(F.col("node_id").alias("dst"), F.col("id").alias("b"))
    return found.join(a, "src").join(b, "dst").select("layer", "a", "b", "la", "weight")


def triples_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trade graph as lines of text, read back."""
    e = graphs.trade(spark, sf_dir)
    number = F.when(F.col("layer") == "A", 1).when(F.col("layer") == "N", 2).otherwise(3)
    return graphs.layered_triples(e.select(F.format_string("  %d %d\t%d ", number, F.col("src") + 1, F.col("dst") + 1).alias("value")))


def triplet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trade graph as exported cells, some of them negative."""
    cells = graphs.trade(spark, sf_dir).select("layer", F.col("src").alias("i"), F.col("dst").alias("j"), (F.col("weight") - 30).alias("x"))
    return graphs.triplets(cells, binary=False)


def known_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.known_labels(graphs.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.when(F.col("c_nationkey") == 7, 1e300).otherwise(F.col("c_nationkey").cast("double")).alias("label")))


def one_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trade graph without layers, its edges binary by default."""
    return graphs.single_layer(graphs.trade(spark, sf_dir).select("src", "dst").distinct())


def shared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are both customers and suppliers."""
    return graphs.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")).intersect(graphs.read(spark, sf_dir, "supplier").select("s_suppkey"))


def column_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, last and middle parts of the vectors."""
    v = graphs.read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    total = lambda x: shown(F.aggregate(x, F.lit(0.0), lambda s, y: s + y))
    return v.select("vec_id", total(F.slice("v", 1, 1)).alias("first"), total(F.slice("v", -1, 1)).alias("last"), total(F.slice("v", F.lit(2), F.size("v") - 2)).alias("middle"))


def written_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A results table written as Parquet, CSV and tab-separated text, and read again."""
    rows, to = cut(melt_methods(spark, sf_dir)), f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    sinks.write_results(rows, f"{to}/parquet")
    sinks.write_table(rows, f"{to}/csv")
    sinks.write_table(rows, f"{to}/tsv", tab=True)
    every = [spark.read.parquet(f"{to}/parquet")] + [spark.read.csv(f"{to}/{kind}", header=True, sep=sep, schema=rows.schema) for kind, sep in (("csv", ","), ("tsv", "\t"))]
    return reduce(DataFrame.unionAll, every).groupBy("metric").agg(F.count(F.lit(1)).alias("n"), shown(F.sum("value")).alias("value"))


def base(g: Graph) -> DataFrame:
    """A base partition of each layer: its number of letters moves the labels."""
    return edges.everywhere(g.nodes, g.layers).select("layer", "node", ((F.col("node") * F.length("layer") + F.floor(F.col("node") / 7)) % 4).cast("int").alias("c"))


def coassoc_pairs(g: Graph) -> DataFrame:
    return consensus.coassociation(base(g))


def bipartite_wy(g: Graph) -> DataFrame:
    w = consensus.cluster_affinity(base(g))
    return rounded(w.select("pl", F.col("pc").cast("long").alias("pc"), "ql", F.col("qc").cast("long").alias("qc"), "w"), "w")


def lap_matvec(g: Graph) -> DataFrame:
    x = g.nodes.select("node", noise(F.col("node"), "x").alias("value"))
    return rounded(consensus.laplacian_product(base(g), x), "y")


def factor(g: Graph) -> DataFrame:
    return g.nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(R - 1))).alias("k")).select("node", "k", generate.uniform(F.lit("h"), F.col("node"), F.col("k")).alias("value"))


def skinny_product(g: Graph) -> DataFrame:
    return by_cell(rounded(linear.times(g.shared, factor(g)), "value"), "node", "k", "value")


def gram_matrix(g: Graph) -> DataFrame:
    h = factor(g)
    return by_cell(rounded(linear.gram(h, linear.times(g.shared, h)), "value"), "p", "q", "value")


def orth_nnls_assign(g: Graph) -> DataFrame:
    found = linear.orthogonal_nnls(g.shared, factor(g))
    return by_cell(rounded(found, "w"), "node", "c", "w")


def sspa_pick1(g: Graph) -> DataFrame:
    return rounded(pairs.extreme_columns(g.shared, 10), "part")


def snmtf_iter1(g: Graph) -> DataFrame:
    """H after one update with S of ones."""
    import numpy as np

    h = cut(factor(g))
    numerator = linear.turned(linear.times(g.shared, h), np.ones((R, R)))
    new = factors.updated(h, numerator, linear.turned(h, linear.matrix(linear.gram(h, numerator), R)))
    return by_cell(rounded(new, "value"), "node", "k", "value")


def elbow(g: Graph) -> DataFrame:
    return windows.elbow(edges.degrees(g.shared).withColumnRenamed("deg", "value")).select("layer", F.col("q").cast("long").alias("q"))


def relabel_by_degree(g: Graph) -> DataFrame:
    return by_cell(blocks.by_total_degree(g.edges, g.part), "node", "c", "rank")


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A results table: return flags as methods, suppliers' nations as parameters, line numbers as seeds."""
    items = graphs.read(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).cast("double").alias("parameter"), F.col("l_returnflag").alias("method"), F.col("l_linenumber").alias("seed"))
    return items.agg(F.avg("l_discount").alias("error"), F.avg("l_tax").alias("nmi"), F.when(F.col("seed") != 3, F.avg("l_quantity")).alias("ari"))


def summary_mean_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = experiments.summary(profile(spark, sf_dir), ["parameter", "method"])
    return rounded(out, *(c for c in out.columns if c not in ("parameter", "method")))


def summary_mean_sd_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(experiments.mean_sd_se(profile(spark, sf_dir), ["parameter", "method"], "ari"), "mean", "sd", "se")


def pivot_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = profile(spark, sf_dir).groupBy("parameter", "method").agg(F.round(F.avg("error"), 6).alias("error"))
    return experiments.wider(means, ["parameter"], ["A", "N", "R"], "error")


def melt_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = profile(spark, sf_dir).select("parameter", "method", F.col("seed").cast("long").alias("seed"), *(F.round(c, 6).alias(c) for c in ("error", "nmi")))
    return experiments.longer(wide, ["parameter", "method", "seed"], ["error", "nmi"])


def best_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of least error for each parameter and method, ties to the smaller seed."""
    p = profile(spark, sf_dir).withColumn("error", F.round("error", 9))
    return p.groupBy("parameter", "method").agg(F.min_by("seed", F.struct("error", "seed")).cast("long").alias("seed"))


def convergence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error by line number over suppliers and flags, as sweeps over trials."""
    history = profile(spark, sf_dir).select((F.col("parameter") * 10).cast("int").alias("trial"), F.col("seed").alias("iteration"), "error")
    out = experiments.convergence(history)
    return rounded(out, "mean", "sd", "least", "most").withColumn("iteration", F.col("iteration").cast("long"))


def final_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last line number of each supplier group's returned items."""
    history = profile(spark, sf_dir).filter("method = 'R'").select(F.col("parameter").cast("long").alias("trial"), F.col("seed").cast("long").alias("iteration"), "error")
    return rounded(experiments.final_states(history), "error")


def results_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.report(profile(spark, sf_dir), ["method"], ["error", "ari"])


def gen_sbm_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.planted(spark, generate.Planted(n=90, layers=3))[0].select("layer", "src", "dst")


#: Planted scenarios that are counted: the generator's, one of power-law weights, and one with more edges.
DRAWN = generate.SCENARIOS | {"power": {"theta": "pow"}, "dense": {"degree": 24.0}}


def gen_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = [generate.planted(spark, generate.Planted(n=60, layers=2, **own))[0].groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("src") * F.col("dst")).alias("cells")).withColumn("scenario", F.lit(name)) for name, own in DRAWN.items()]
    return reduce(DataFrame.unionByName, drawn)


def daily_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.edge_counts(Incidence(graphs.daily_activity(spark, sf_dir)))


def fit_parallel(g: Graph) -> DataFrame:
    """The first sweep of the distributed solver: error, change of weights, share of moved nodes."""
    found = fit.fit_parallel(g.shared, g.nodes, g.part, R, rounds=1).history
    return rounded(found, "error", "z_change", "frac_changed").select(F.col("iteration").cast("long").alias("iteration"), "error", "z_change", "frac_changed")


def snmf_step(g: Graph) -> DataFrame:
    """H after one update of the symmetric factorization of the sum of the layers."""
    h = cut(factor(g))
    new = factors.updated(h, linear.times(g.shared, h), linear.turned(h, linear.matrix(linear.gram(h, h), R)), half=True)
    return by_cell(rounded(new, "value"), "node", "k", "value")


#: Communities of the graph planted over the users.
PLANTED = 3


class PlantedGraph:
    """A graph drawn over the users of the events: three layers, the community of a user its number mod 3, a fifth of all pairs joined, ten times as many inside."""

    def __init__(self, spark: SparkSession, sf_dir: str, layers: int = 3):
        users = cut(graphs.users(spark, sf_dir))
        n = users.count()
        self.law, self.users = generate.Planted(n=n, k=PLANTED, layers=layers, degree=n / 5, theta="one", p=0.5, q=0.05), users
        e, nodes = generate.planted(spark, self.law, users)
        self.spark, self.drawn, self.truth = spark, e, cut(nodes)
        self.nodes = self.truth.select("node")
        self.labels = self.truth.select("node", F.col("c").alias("label"))

    @cached_property
    def edges(self) -> DataFrame:
        return cut(self.drawn)

    @cached_property
    def packed(self) -> packed.Packed | DataFrame:
        """The graph as bits where the driver can hold factors of PLANTED columns, else its edges."""
        return generate.planted_tiles(self.spark, self.law, self.users)[0] if fit.held(self.law.n, PLANTED, self.law.layers) else self.drawn


def named(found: DataFrame) -> DataFrame:
    """(node, community): labels (node, c) by the smallest node of each community, so that their numbers do not matter."""
    least = found.groupBy("c").agg(F.min("node").alias("community"))
    return found.join(least, "c").select("node", "community")


def on_planted(f: Callable[[PlantedGraph], DataFrame], layers: int = 3) -> Query:
    return lambda spark, sf_dir: f(PlantedGraph(spark, sf_dir, layers))


def by_method(name: str) -> Query:
    return on_planted(lambda g: named(methods.detect(name, g.edges, g.nodes, PLANTED, 1)), 1 if name == "omni" else 3)


def fit_exact(g: PlantedGraph) -> DataFrame:
    return named(fit.fit_exact(g.edges, g.nodes, exact.Options(r=PLANTED)).assign)


def fit_shared(g: PlantedGraph) -> DataFrame:
    return named(fit.fit_exact(g.edges, g.nodes, exact.Options(r=PLANTED, shared=True)).assign)


def fit_restarts(g: PlantedGraph) -> DataFrame:
    """The distributed solver from consensus starts."""
    return named(fit.fit_restarts(g.packed, g.nodes, exact.Options(r=PLANTED, trials=2, rounds=5)).assign)


def noisy_base(g: PlantedGraph) -> DataFrame:
    """Five partitions: the planted one with other numbers, a tenth of the nodes elsewhere."""
    many = g.truth.select("node", "c", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("i"))
    wrong = generate.uniform(F.lit("base"), F.col("node"), F.col("i")) < 0.1
    return cut(many.select(F.col("i").cast("string").alias("layer"), "node", ((F.col("c") + F.col("i") + F.when(wrong, 1).otherwise(0)) % PLANTED).cast("int").alias("c")))


def consensus_labels(g: PlantedGraph) -> DataFrame:
    return named(consensus.consensus(noisy_base(g), PLANTED))


def consensus_matrix_free(g: PlantedGraph) -> DataFrame:
    return named(consensus.consensus(noisy_base(g), PLANTED, matrix_free=True))


def real_study(g: PlantedGraph) -> DataFrame:
    """Methods of the study of real networks, two trials, as text."""
    return experiments.report(experiments.real_study(g.edges, g.labels, trials=2), ["method"], ["error", "nmi", "ari"])


def convergence_study(g: PlantedGraph) -> DataFrame:
    """Agreement after six sweeps from consensus starts."""
    found = experiments.convergence_study(g.edges, g.labels, trials=2, rounds=6, starts=["usenc"])
    return found.filter("iteration = 5").select("start", F.col("trial").cast("long").alias("trial"), shown(F.col("nmi")).alias("nmi"), shown(F.col("ari")).alias("ari"))


def scalability_study(g: PlantedGraph) -> DataFrame:
    found = experiments.scalability_study(g.edges, g.labels, trials=2)
    return found.select(F.col("trial").cast("long").alias("trial"), (F.col("iterations") > 0).alias("swept"), shown(F.col("nmi")).alias("nmi"), shown(F.col("ari")).alias("ari"))


def simulation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = experiments.grid(spark, ["sim1", "sim6"], [1, 3], 3)
    found = experiments.simulate(cells, {"joint": exact.Options(r=3, trials=1, rounds=10), "random": exact.Options(r=3, trials=1, rounds=10, init="random")})
    return experiments.summary(found, ["scenario", "parameter", "method"])


def main_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main study, two repetitions of a few layers."""
    return experiments.summary(experiments.main_study(spark, 2, [2, 5], scenarios=["sim1", "sim3"]), ["scenario", "parameter", "method"])


def sparsity_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The study of densities, two repetitions of a few."""
    return experiments.summary(experiments.sparsity_study(spark, 2, [4, 16], scenarios=["sim1"], methods=["dcmase", "ave_spherical", "lmfo", "us"]), ["scenario", "parameter", "method"])


QUERIES: dict[str, Query] = {
    f.__name__: on_graph(f)
    for f in (
        deg_by_layer, layer_norm, layer_stats, layer_summary, layer_table, transitivity, layer_similarity, mean_similarity, sum_graph, mean_graph, upper_weight, norm_adj_tau, diag_augmented, bias_adjusted_square,
        community_mass, degree_share, unit_weights, block_sum_s, block_mean_b, block_normalized, block_density, degree_correction, recon_error, sweep_coeffs, quartic, sweep_assign,
        sweep_assign_shared, sweep_error, modularity, coassoc_pairs, bipartite_wy, lap_matvec, skinny_product, gram_matrix, orth_nnls_assign, sspa_pick1, snmtf_iter1, elbow, elbows,
        relabel_by_degree, largest_rows, column_means, expected_adjacency, matrix_distance, matched_columns, large_values, parts_of, fit_parallel, snmf_step,
    )
} | {
    f.__name__: f
    for f in (
        components, symmetrize_binarize, contingency, nmi, ari, misclass, knn_layer, knn_symmetric, mean_removed_angle, summary_mean_sd, summary_mean_sd_se, pivot_methods, melt_methods,
        best_restart, gen_sbm_edges, gen_scenarios, daily_layers, simulation_grid, main_study, sparsity_study, dense_ids, contact_days, citation_graph, triples_text, triplet_cells, known_labels,
        one_layer, shared_names, column_slices, written_back, convergence_stats, final_states, results_text,
    )
} | {
    f.__name__: on_planted(f) for f in (fit_exact, fit_shared, fit_restarts, consensus_labels, consensus_matrix_free, real_study, convergence_study, scalability_study)
} | {f"method_{name.replace('-', '_')}": by_method(name) for name in methods.METHODS}
