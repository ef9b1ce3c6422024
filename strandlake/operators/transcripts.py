"""Transcripts from a count graph: welds by reads, growth from seeds, a cover of each splice graph by paths, abundance.

Nodes of the splice graph are unbranched paths on both strands, its steps are welds: reads that run from one
path straight into the next. What a read says holds for the other strand too, so all tables are alike on
both strands and labels that grow forwards also tell what lies ahead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.seq import entropy0, reverse_complement
from strandlake.operators.compact import positions, segments
from strandlake.operators.components import tied
from strandlake.operators.supergraph import align_reads, edge_index, not_entailed, superpaths
from strandlake.sources.staging import free, staged


def read_steps(aligned: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v, n; u, v, w, n): reads that run from path u straight into v, and from u through the whole of v into w, on both strands."""
    read = Window.partitionBy("read_id").orderBy("pos")
    before = F.lag(F.struct("pos", "path", "offset")).over(read)
    held = aligned.withColumn("b", before).where("b is null or b.pos <> pos - 1 or b.path <> path or b.offset <> offset")
    held = held.withColumn("u", F.expr("if(b.pos = pos - 1, b.path, null)"))
    ahead = F.lead(F.struct("u", F.col("path").alias("w"))).over(read)
    held = staged(held.withColumn("a", ahead).where("u is not null").select("u", F.col("path").alias("v"), F.expr("if(a.u is not null, a.w, null)").alias("w")), "steps")
    other = paths.select("path", "rc_path")
    names = {c: other.select(F.col("path").alias(c), F.col("rc_path").alias("r" + c)) for c in "uvw"}
    two = held.groupBy("u", "v").agg(F.count("*").alias("n")).join(names["u"], "u").join(names["v"], "v")
    three = held.where("w is not null").groupBy("u", "v", "w").agg(F.count("*").alias("n")).join(names["u"], "u").join(names["v"], "v").join(names["w"], "w")
    two = two.select("u", "v", "n").unionByName(two.where("u <> rv or v <> ru").selectExpr("rv as u", "ru as v", "n"))
    three = three.select("u", "v", "w", "n").unionByName(three.where("u <> rw or v <> rv or w <> ru").selectExpr("rw as u", "rv as v", "ru as w", "n"))
    return two.groupBy("u", "v").agg(F.sum("n").alias("n")), three.groupBy("u", "v", "w").agg(F.sum("n").alias("n"))


def strong_welds(steps: DataFrame, paths: DataFrame, weld: float = 0.04, least: int = 4, trim: float = 0.05) -> DataFrame:
    """u, v, n of the steps that at least so many reads take, no less than weld of either path's coverage and than trim of the strongest step of their fork."""
    mean = [paths.select(F.col("path").alias(c), F.col("mean").alias("m" + c)) for c in "uv"]
    held = steps.where(F.col("n") >= least).join(mean[0], "u").join(mean[1], "v").where(F.col("n") >= weld * F.greatest("mu", "mv"))
    fork = [F.max("n").over(Window.partitionBy(c)) for c in "uv"]  # a path has at most four neighbours on a side
    return held.withColumn("top", F.greatest(*fork)).where(F.col("n") >= trim * F.col("top")).select("u", "v", "n")


def grown(paths: DataFrame, welds: DataFrame, ratio: float = 0.0) -> DataFrame:
    """u, v, n: steps without reads that join an end without a weld to a beginning without one, each at most once.

    The best covered step is taken first (by the lesser coverage of its paths, n), as a seed grows to its best
    neighbour; all steps that are the best of both their ends are taken in one round. Paths whose coverages
    differ by more than ratio aren't joined.
    """
    begin = paths.select(F.col("path").alias("u"), F.col("rc_path").alias("ru"), F.col("end").alias("node"), F.col("mean").alias("mu")).join(welds.select("u"), "u", "left_anti")
    end = paths.select(F.col("path").alias("v"), F.col("rc_path").alias("rv"), F.col("start").alias("node"), F.col("mean").alias("mv")).join(welds.select("v"), "v", "left_anti")
    links = begin.join(end, "node").where("u <> v and u <> rv").where(F.least("mu", "mv") >= ratio * F.greatest("mu", "mv"))
    order = F.struct((-F.least("mu", "mv")).alias("m"), F.least(F.struct("u", "v"), F.struct(F.col("rv").alias("u"), F.col("ru").alias("v"))).alias("name"))
    links = staged(links.select("u", "v", F.greatest(F.lit(1), F.floor(F.least("mu", "mv"))).cast("long").alias("n"), order.alias("o")), "neighbours")
    taken, spent = None, [links]
    while taken is None or not links.isEmpty():
        best = [F.min("o").over(Window.partitionBy(c)) for c in "uv"]
        new = staged(links.withColumn("bu", best[0]).withColumn("bv", best[1]).where("o = bu and o = bv").select("u", "v", "n"), "grown")
        taken = new if taken is None else taken.unionByName(new)
        links = staged(links.join(new.select("u"), "u", "left_anti").join(new.select("v"), "v", "left_anti").select("u", "v", "n", "o"), "neighbours")
        spent.append(links)
    out = staged(taken, "growth")
    free(*spent)
    return out


def transitions(welds: DataFrame, spans: DataFrame, least: int = 4, weld: float = 0.04) -> DataFrame:
    """u, v, w, n, phased: welds that may follow each other.

    Where at least so many reads run through the whole of v, only what enough of them say goes on (no less than weld of them all);
    where v is too long for reads, every way out follows every way in, as strong as the weaker weld.
    """
    after = welds.select(F.col("u").alias("v"), F.col("v").alias("w"), F.col("n").alias("m"))
    held = welds.join(after, "v").join(spans.select("u", "v", "w", F.col("n").alias("s")), ["u", "v", "w"], "left")
    held = held.withColumn("all", F.sum(F.coalesce("s", F.lit(0))).over(Window.partitionBy("v")))
    phased = F.col("all") >= least
    held = held.where(~phased | ((F.col("s") >= least) & (F.col("s") >= weld * F.col("all"))))
    return held.select("u", "v", "w", F.when(phased, F.least("s", "n", "m")).otherwise(F.least("n", "m")).alias("n"), phased.alias("phased"))


def _least(label: DataFrame) -> DataFrame:
    """u, v, width, prior, route: the strongest label of each weld; of equals the one that was least strong before it, the shortest, the first by its paths."""
    best = F.min(F.struct((-F.col("width")).alias("w"), "prior", F.size("route").alias("s"), "route"))
    return label.groupBy("u", "v").agg(best.alias("b")).select("u", "v", (-F.col("b.w")).alias("width"), "b.prior", "b.route")


#: Whether the step from v to w is on the route already.
AGAIN = "exists(sequence(1, size(route) - 1), i -> route[i - 1] = v and route[i] = w)"


def ways_in(welds: DataFrame, follow: DataFrame, home: DataFrame) -> DataFrame:
    """u, v, width, route (array of paths, to v): the strongest way from where the splice graph begins through each weld.

    A way is as strong as its weakest step and takes no weld twice; of equally strong ways into a weld the one that was
    least strong before it is taken, so that weak arms go with weak arms. Welds of cycles that nothing leads into begin at the strongest of
    their component (home: path, component), the first by name of equals. A round is one join and one aggregation over all components.
    """
    first = welds.join(follow.select(F.col("v").alias("u"), F.col("w").alias("v")), ["u", "v"], "left_anti")
    into = staged(follow.join(welds.select(F.col("u").alias("v"), F.col("v").alias("w"), F.col("n").alias("m")), ["v", "w"]).select("u", "v", "w", F.least("n", "m").alias("n")), "follow")
    begins = lambda held: held.select("u", "v", F.col("n").alias("width"), F.col("n").alias("prior"), F.array("u", "v").alias("route"), F.lit(True).alias("new"))
    state = staged(begins(first), "ways")
    while True:
        while not state.where("new").isEmpty():
            on = state.where("new").join(into, ["u", "v"]).where(f"not {AGAIN}").select(F.col("v").alias("u"), F.col("w").alias("v"), F.least("width", "n").alias("width"), F.col("width").alias("prior"), F.concat("route", F.array("w")).alias("route"))
            best = _least(state.select("u", "v", "width", "prior", "route").unionByName(on))
            had = state.select("u", "v", F.col("route").alias("old"))
            old, state = state, staged(best.join(had, ["u", "v"], "left").select("u", "v", "width", "prior", "route", F.expr("old is null or old <> route").alias("new")), "ways")
            free(old)
        rest = staged(welds.join(state, ["u", "v"], "left_anti").join(home.withColumnRenamed("path", "u"), "u").select("u", "v", "n", "component"), "rings")
        if rest.isEmpty():
            free(into, rest)
            return state.select("u", "v", "width", "route")
        heads = rest.groupBy("component").agg(F.min(F.struct((-F.col("n")).alias("n"), "u", "v")).alias("b")).select("b.u", "b.v", (-F.col("b.n")).alias("n"))
        old, state = state, staged(state.withColumn("new", F.lit(False)).unionByName(begins(heads)), "ways")
        free(old, rest)


#: Steps of ahead, from its second path on, that behind has not taken yet; what follows the first taken one is left out.
UNTAKEN = """slice(ahead, 2, coalesce(array_min(filter(sequence(1, size(ahead) - 1),
i -> array_contains(transform(sequence(1, size(behind) - 1), j -> struct(behind[j - 1] as a, behind[j] as b)), struct(ahead[i - 1] as a, ahead[i] as b)))) - 1, size(ahead) - 1))"""


def cover(welds: DataFrame, follow: DataFrame, home: DataFrame, paths: DataFrame) -> DataFrame:
    """route (array of paths), width: for every weld, and for every step that reads phase, the strongest way that runs through it, once for both strands.

    So a Y or a bubble gives a transcript for each arm, no arm is lost, and there are no more than welds and phased steps.
    No weld is taken twice: a way that comes back to one ends there.
    """
    behind = staged(ways_in(welds, follow, home), "behind")
    names = paths.select("path", "rc_path")
    # what leads out of a weld is what leads into its other strand, turned round
    turned = behind.select("u", "v", "width", F.posexplode(F.reverse("route")).alias("i", "path")).join(names, "path")
    turned = turned.groupBy("u", "v", "width").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "rc_path"))), lambda x: x["rc_path"]).alias("ahead"))
    ahead = staged(turned.select(F.expr("ahead[0]").alias("u"), F.expr("ahead[1]").alias("v"), "ahead", F.col("width").alias("more")), "ahead")
    into = behind.select("u", "v", F.col("route").alias("behind"), "width")
    through = into.join(ahead, ["u", "v"]).select("behind", F.expr("slice(ahead, 2, size(ahead) - 1)").alias("ahead"), F.least("width", "more").alias("width"))
    out = ahead.select(F.col("u").alias("v"), F.col("v").alias("w"), "ahead", "more")
    phased = follow.where("phased").join(into, ["u", "v"]).join(out, ["v", "w"]).select("behind", "ahead", F.least("width", "more", "n").alias("width"))
    route = F.expr(f"if(size(ahead) < 2, behind, concat(behind, {UNTAKEN}))")
    routes = staged(through.unionByName(phased).select(route.alias("route"), "width").groupBy("route").agg(F.max("width").alias("width")), "routes")
    other = routes.select(F.col("route").alias("own"), "width", F.posexplode(F.reverse("route")).alias("i", "path")).join(names, "path")
    other = other.groupBy("own", "width").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "rc_path"))), lambda x: x["rc_path"]).alias("other"))
    return other.groupBy(F.least("own", "other").alias("route")).agg(F.max("width").alias("width"))


def spelled(routes: DataFrame, paths: DataFrame, k: int) -> DataFrame:
    """transcript (sha256 of its bases), route, seq, n_paths of array route."""
    piece = F.when(F.col("i") == 0, F.col("seq")).otherwise(F.expr(f"substring(seq, {k + 1})"))
    parts = routes.select("route", F.posexplode("route").alias("i", "path")).join(paths.select("path", "seq"), "path").select("route", "i", piece.alias("piece"))
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "piece"))), lambda x: x["piece"]), "")
    held = parts.groupBy("route").agg(seq.alias("seq"), F.count("*").alias("n_paths"))
    return held.select(F.sha2("seq", 256).alias("transcript"), "route", "seq", "n_paths")


def abundance(made: DataFrame, aligned: DataFrame, paths: DataFrame) -> DataFrame:
    """transcript, reads, fpkm. A read counts for the transcripts that hold most of its paths, in equal parts.

    Reads through the same paths are counted together before they meet transcripts. fpkm: reads a thousand bases and million placed reads.
    """
    strandless = paths.select("path", F.least("path", "rc_path").alias("p"))
    used = staged(made.select("transcript", F.explode("route").alias("path")).join(strandless, "path").select("transcript", "p").distinct(), "used")
    held = aligned.join(strandless, "path").join(used.select("p").distinct(), "p", "left_semi")
    classes = held.groupBy("read_id").agg(F.sort_array(F.collect_set("p")).alias("ps")).groupBy("ps").agg(F.count("*").alias("n"))
    classes = staged(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 1
    shared = classes.select("class", F.explode("ps").alias("p")).join(used, "p").groupBy("class", "transcript").agg(F.count("*").alias("m"))
    top = shared.withColumn("top", F.max("m").over(Window.partitionBy("class"))).where("m = top").withColumn("parts", F.count("*").over(Window.partitionBy("class")))
    reads = top.join(classes.select("class", "n"), "class").groupBy("transcript").agg(F.sum(F.col("n") / F.col("parts")).alias("reads"))
    held = made.select("transcript", F.length("seq").alias("length")).join(reads, "transcript", "left").withColumn("reads", F.coalesce("reads", F.lit(0.0)))
    return held.select("transcript", "reads", (F.col("reads") * 1e9 / (F.col("length") * F.lit(total))).alias("fpkm"))


def _seed(paths: DataFrame, coverage: float, entropy: float) -> Column:
    return (F.col("mean") >= coverage) & (entropy0("seq") >= entropy)


def assemble(edges: DataFrame, reads: DataFrame, k: int, min_length: int = 0, seed_coverage: float = 2, seed_entropy: float = 1.5, weld: float = 0.04, least: int = 4, trim: float = 0.05, min_coverage: float = 1, ratio: float = 0.0, least_reads: float = 0.0) -> DataFrame:
    """transcript, component, seq, length, n_paths, support, reads, fpkm; one strand of each.

    Paths of at least min_coverage are welded where at least least reads run from one into the next; ends without a
    weld grow to their best covered neighbour. Every weld, and every step that reads phase, lies on a transcript, by the strongest way
    through it (support: reads at its weakest step, null for a path alone). A transcript has a path with enough coverage and
    base composition for a seed, lies in no longer one, and at least least_reads reads count for it. Reads without a known path, empty
    reads and nulls count for nothing; an empty graph gives no rows.
    """
    placed = positions(edges)
    paths = staged(superpaths(segments(edges, placed), k).where(F.col("mean") >= min_coverage), "paths")
    aligned = staged(align_reads(reads, edge_index(edges, placed), k).join(paths.select("path"), "path", "left_semi"), "aligned")
    steps, spans = read_steps(aligned, paths)
    welds = staged(strong_welds(steps, paths, weld, least, trim), "welds")
    welds = staged(welds.unionByName(grown(paths, welds, ratio)), "welds")
    ties = tied(welds.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(paths.select(F.col("path").alias("a"), F.col("rc_path").alias("b"))))
    home = staged(paths.select("path").join(ties.select(F.col("a").alias("path"), "b"), "path", "left").select("path", F.coalesce("b", "path").alias("component")), "homes")
    follow = staged(transitions(welds, spans, least, weld), "transitions")
    routes = cover(welds, follow, home, paths)
    joined = welds.select("u").unionByName(welds.select(F.col("v").alias("u"))).distinct().withColumnRenamed("u", "path")
    alone = paths.join(joined, "path", "left_anti").where("path <= rc_path").select(F.array("path").alias("route"), F.lit(None).cast("long").alias("width"))
    routes = staged(routes.unionByName(alone), "routes")
    seeds = paths.where(_seed(paths, seed_coverage, seed_entropy)).select("path")
    begun = routes.select("route", F.explode("route").alias("path")).join(seeds, "path").select("route").distinct()
    made = spelled(routes.join(begun, "route", "left_semi"), paths, k).where(F.length("seq") >= min_length)
    made = staged(not_entailed(staged(made.withColumnRenamed("transcript", "contig"), "spelled"), k + 1).withColumnRenamed("contig", "transcript"), "transcripts")
    out = made.join(abundance(made, aligned, paths), "transcript").where(F.col("reads") >= least_reads).join(routes.withColumnRenamed("width", "support"), "route")
    out = out.withColumn("path", F.expr("route[0]")).join(home, "path")
    return out.select("transcript", "component", F.least("seq", reverse_complement("seq")).alias("seq"), F.length("seq").cast("long").alias("length"), "n_paths", "support", "reads", "fpkm")
