"""Commands: python -m weftmap.cli COMMAND ... ; run them with spark-submit on a cluster. Inputs are pairs files or folders of Parquet."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from . import api
from .functions import pairs as P
from .operators import balance as B
from .operators import maps as M
from .operators import pairs as O
from .operators import tracks as T
from .sources import text as S


def _pairs(spark: SparkSession, path: str, nrows: int | None = None) -> DataFrame:
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else S.read_pairs(spark, path)
    return df.limit(nrows) if nrows else df


def _write(df: DataFrame, path: str) -> None:
    if path.rstrip("/").endswith(".parquet"):
        df.write.parquet(path)
    else:
        S.write_pairs(df, path)


def shift_pairs(spark, a):
    df = _pairs(spark, a.pairs)
    _write(P.with_shift(df, a.protected_over_2) if a.mode == "orientation" else P.with_median(df), a.output)


def filter_pairs(spark, a):
    regions = S.read_bed(spark, a.regions) if a.regions else None
    _write(O.valid_pairs(_pairs(spark, a.pairs), S.read_chrom_sizes(spark, a.chrom_sizes), a.direction, a.min_distance, regions), a.output)


def analyze_pairs(spark, a):
    S.write_curves(O.raw_and_shifted(_pairs(spark, a.pairs, a.nrows), a.protected_over_2), a.output)


def base_ps(spark, a):
    S.write_curves(O.distance_curves(_pairs(spark, a.pairs, a.nrows), a.max_distance).orderBy("distance"), a.output or a.pairs + ".base_ps.csv")


def bin_pairs(spark, a):
    bins = M.make_bins(S.read_chrom_sizes(spark, a.chrom_sizes), a.resolution)
    api.save_store(bins, M.count_pixels(_pairs(spark, a.pairs), bins, a.resolution), a.store, a.resolution)


def remove_inward(spark, a):
    bins, inward_bins = (S.read_store(spark, f"{p}/bins", a.resolution) for p in (a.full, a.inward))
    M.check_same_bins(bins, inward_bins)
    full, inward = (S.read_store(spark, f"{p}/pixels", a.resolution) for p in (a.full, a.inward))
    api.save_store(bins, M.remove_inward(full, inward, bins, a.resolution, a.k), a.output, a.resolution)


def zoomify(spark, a):
    coarser = [int(r) for r in a.resolutions.split(",")] if a.resolutions else [a.resolution * 2**k for k in range(1, 10)]
    how = {"ignore_diags": a.ignore_diags, "mad_max": a.mad_max, "min_nnz": a.min_nnz, "min_count": a.min_count, "tol": a.tol, "max_iter": a.max_iter}
    for r, done in api.zoom_store(spark, a.store, a.resolution, coarser, a.balance, **how).items():
        print(r, *([f"{done.rounds} rounds, variance {done.variance}, {'converged' if done.converged else 'not converged'}"] if done else []))


def merge_pairs(spark, a):
    df = _pairs(spark, a.pairs[0])
    for path in a.pairs[1:]:
        df = df.unionByName(_pairs(spark, path))
    _write(df, a.output)


def merge_maps(spark, a):
    """The sum of stores of the same bins."""
    bins = [S.read_store(spark, f"{p}/bins", a.resolution) for p in a.stores]
    for b in bins[1:]:
        M.check_same_bins(bins[0], b)
    merged = M.merge_pixels(*(S.read_store(spark, f"{p}/pixels", a.resolution) for p in a.stores))
    api.save_store(bins[0].drop("weight", "weight_neighbor"), merged, a.output, a.resolution)


def batch_factors(spark, a):
    conditions, regions = a.conditions.split(","), a.regions.split(",")
    maps = api.load_maps(spark, a.root, conditions, regions, a.pattern)
    for r in api.batch_reports(maps, a.reference, conditions, a.reference_separation).orderBy("condition", "region").collect():  # one row a map
        print(f"query={r.condition} reference={a.reference} region={r.region} global_factor={r.global_factor} factors={r.factors}")


def neighbor_weights(spark, a):
    if not 200 <= a.neighbor_res <= 400:
        print("neighbour resolutions outside 200 to 400 are not recommended")
    print(*api.add_neighbor_weights(spark, a.store, a.neighbor_res))


def region_balance(spark, a):
    m = api.ContactMap.from_store(spark, a.store, a.resolution, a.region, balance=False)
    rates = None
    if a.capture_probes_path:
        regions = spark.createDataFrame([(m.chrom, m.chrom, m.start, m.end)], "region string, chrom string, start long, end long")
        rates = M.capture_rates(S.read_bed(spark, a.capture_probes_path), regions, a.resolution)
    how = {"max_iter": a.max_iter, "tol": a.tol, "flanks": a.correct_for_flanks, "sigma": B.growing_width(a.sigma_scale, a.sigma_exponent, a.sigma_plateau)}
    m.balance(rates, a.mad_max, a.min_nnz, a.min_pair_capture_rate, **how).save(a.output, a.dtype == "float32")


def pairs_to_bed(spark, a):
    ends = O.read_ends(_pairs(spark, a.pairs), S.read_chrom_sizes(spark, a.chrom_sizes), a.protected_over_2, a.median, a.pair_type)
    cols = ["chrom", "start", "end", "strand"]
    if a.length_threshold is None:
        S.write_bed(ends.select(*cols), a.output)
    else:
        S.write_bed(O.ends_by_length(ends, a.length_threshold).select(*cols, "length_class"), a.output, "length_class")


def pairs_length_heatmap(spark, a):
    chrom, start, end = S.parse_region(a.region)
    df = _pairs(spark, a.pairs[0])
    for path in a.pairs[1:]:
        df = df.unionByName(_pairs(spark, path))
    S.write_curves(O.length_heatmap(df, chrom, start, end, a.length_min, a.length_max, a.bin_size, a.pair_type), a.output)


def select_wig_track(spark, a):
    S.select_wig_track(spark, a.path, a.track).orderBy("line_no").select("line").write.text(a.output)


def bedgraph_merge(spark, a):
    S.write_bed(T.drop_overlaps(S.read_bedgraph(spark, a.path), ["chrom"], "start", "end", ["end"]).orderBy("chrom", "start"), a.output)


def gtab_to_bedgraph(spark, a):
    S.write_bed(S.table_to_bedgraph(S.read_table(spark, a.path), a.column), a.output or f"{a.path.removesuffix('.gtab.txt')}_{a.column}.bedgraph")


#: Command -> (function, positional arguments, options with their defaults).
COMMANDS = {
    "shift-pairs": (shift_pairs, ["pairs", "output"], {"protected-over-2": 65, "mode": "orientation"}),
    "filter-pairs": (filter_pairs, ["chrom_sizes", "pairs", "output"], {"regions": "", "direction": None, "min-distance": 0}),
    "analyze-pairs": (analyze_pairs, ["pairs", "output"], {"protected-over-2": 65, "nrows": 1_000_000}),
    "base-ps": (base_ps, ["pairs"], {"nrows": 0, "max-distance": 100_000, "output": ""}),
    "bin-pairs": (bin_pairs, ["chrom_sizes", "pairs", "store"], {"resolution": 200}),
    "remove-inward": (remove_inward, ["full", "inward", "output"], {"k": 2, "resolution": 200}),
    "zoomify": (zoomify, ["store"], {
        "resolution": 200, "resolutions": "", "balance": True, "ignore-diags": 0, "mad-max": 5.0, "min-nnz": 10, "min-count": 0, "tol": 1e-5, "max-iter": 200}),
    "merge-pairs": (merge_pairs, ["output", "pairs+"], {}),
    "merge-maps": (merge_maps, ["output", "stores+"], {"resolution": 200}),
    "batch-factors": (batch_factors, ["root", "conditions", "regions", "reference"], {
        "reference-separation": 5, "pattern": "{root}/{condition}/{condition}_output_{region}"}),
    "neighbor-weights": (neighbor_weights, ["store"], {"neighbor-res": 200}),
    "region-balance": (region_balance, ["output", "store", "region"], {
        "resolution": 200, "capture-probes-path": "", "dtype": "float32", "mad-max": 2.0, "min-nnz": 100, "min-pair-capture-rate": 0.2, "max-iter": 50,
        "tol": 1e-5, "correct-for-flanks": True, "sigma-scale": 2.0, "sigma-exponent": 0.2, "sigma-plateau": 2}),
    "pairs-to-bed": (pairs_to_bed, ["chrom_sizes", "pairs", "output"], {"protected-over-2": 0, "median": False, "pair-type": "UU", "length-threshold": None}),
    "pairs-length-heatmap": (pairs_length_heatmap, ["region", "output", "pairs+"], {"length-min": 20, "length-max": 80, "bin-size": 1, "pair-type": "UU"}),
    "select-wig-track": (select_wig_track, ["path", "output"], {"track": None}),
    "bedgraph-merge": (bedgraph_merge, ["path", "output"], {}),
    "gtab-to-bedgraph": (gtab_to_bedgraph, ["path", "column"], {"output": ""}),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="weftmap")
    commands = top.add_subparsers(dest="command", required=True)
    for name, (_, positional, options) in COMMANDS.items():
        c = commands.add_parser(name, formatter_class=argparse.ArgumentDefaultsHelpFormatter)
        for p in positional:
            c.add_argument(p.rstrip("+"), **({"nargs": "+"} if p.endswith("+") else {}))
        for o, default in options.items():
            if isinstance(default, bool):
                c.add_argument(f"--{o}", action=argparse.BooleanOptionalAction, default=default)
            else:
                kind = int if o == "length-threshold" else str if default is None else type(default)
                c.add_argument(f"--{o}", type=kind, default=default)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    COMMANDS[a.command][0](spark or SparkSession.builder.appName("weftmap").getOrCreate(), a)


if __name__ == "__main__":
    main()
