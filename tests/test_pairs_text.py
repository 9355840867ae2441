import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from weftmap import api, cli
from weftmap.functions import pairs as P
from weftmap.operators import maps as M
from weftmap.operators import pairs as O
from weftmap.operators import tracks as T
from weftmap.sources import text as S
from weftmap.streaming import pairs as ST

SCHEMA = (
    "read_id string, chrom1 string, pos1 long, chrom2 string, pos2 long, strand1 string, strand2 string, pair_type string, "
    "pos51 long, pos31 long, pos52 long, pos32 long, run string, loaded_at timestamp_ntz"
)
SIZES = [("chr1", 1_000_000), ("chr2", 1_000_000)]


def row(**kw):
    base = dict(read_id="r", chrom1="chr1", pos1=1000, chrom2="chr1", pos2=2000, strand1="+", strand2="+", pair_type="UU",
                pos51=None, pos31=None, pos52=None, pos32=None, run="a", loaded_at=None)
    return tuple({**base, **kw}.values())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


@pytest.fixture(scope="module")
def sizes(spark):
    return spark.createDataFrame(SIZES, "chrom string, size long")


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="spark-")


def test_shift(spark):
    strands = ["+-", "++", "-+", "--"]
    got = P.with_shift(frame(spark, *[row(strand1=s[0], strand2=s[1]) for s in strands], row(pos1=None)), 70)
    assert [(r.pos1, r.pos2) for r in got.collect()] == [(1070, 1930), (1070, 2070), (930, 2070), (930, 1930), (None, 2070)]


def test_median_shift(spark):
    df = frame(spark, row(pos51=10, pos31=15, pos52=7, pos32=None), row(pos51=-3, pos31=0))
    assert [(r.pos1, r.pos2) for r in P.with_median(df).collect()] == [(12, 2000), (-2, 2000)]
    assert P.with_median(df.drop("pos51")).first().pos1 == 1000


def test_directions(spark):
    df = spark.createDataFrame([("+", "-"), ("-", "+"), ("+", "+"), ("-", "-"), (".", "+"), (None, None)], "s1 string, s2 string")
    a, b = F.col("s1"), F.col("s2")
    got = df.select(P.direction(a, b), P.decay_direction(a, b), P.plot_direction(a, b), P.decay_direction(a, b, True)).collect()
    assert [tuple(r) for r in got] == [
        ("inward", "inward", "inward", "inward"), ("outward", "outward", "outward", "outward"), ("tandemexit", "tandem_entry", "tandem_entry", "tandem_exit"),
        ("tandementry", "tandem_exit", "tandem_exit", "tandem_entry"), (None, "outward", "", "outward"), (None, "tandem_exit", "", "tandem_entry"),
    ]
    with pytest.raises(Exception, match="invalid strands"):
        df.select(P.direction(a, b, strict=True)).collect()


def test_filter(spark, sizes):
    def kept(r, **kw):
        return O.valid_pairs(frame(spark, r), sizes, **kw).count() == 1

    assert kept(row(strand2="-"), direction="inward") and not kept(row(), direction="inward") and not kept(row(), direction="unknown")
    assert not kept(row(pos2=999)) and kept(row(pos2=999), min_distance=-1) and kept(row(chrom2="chr2", pos2=1)) and not kept(row(pair_type="UR"))
    assert not kept(row(pos1=0)) and kept(row(pos1=1)) and kept(row(pos2=1_000_000)) and not kept(row(pos2=1_000_001)) and not kept(row(pos1=None))
    assert not kept(row(chrom1="chrX")) and not kept(row(strand1=None))
    with pytest.raises(Exception, match="unknown chromosome"):
        kept(row(chrom1="chrX"), strict=True)
    regions = spark.createDataFrame([("chr1", 999, 1000), ("chr1", 1990, 2100), ("chr1", 1995, 2000), ("chr2", 0, 9)], "chrom string, start long, end long")
    assert kept(row(), regions=regions) and not kept(row(pos1=999), regions=regions) and not kept(row(pos1=1001), regions=regions)
    assert not kept(row(pos2=1990), regions=regions) and kept(row(pos2=1991), regions=regions) and kept(row(pos2=2100), regions=regions)


def test_duplicates(spark):
    def brute(rows):
        key = lambda r: (r[1], r[3], r[5], r[6])
        left, out = list(range(len(rows))), 0
        while left:
            todo, size = [left.pop(0)], 0
            while todo:
                a = rows[todo.pop()]
                size += 1
                near = [k for k in left if key(rows[k]) == key(a) and abs(rows[k][2] - a[2]) <= 1 and abs(rows[k][4] - a[4]) <= 1]
                left = [k for k in left if k not in near]
                todo += near
            out += size - 1
        return out

    rnd = random.Random(1)
    rows = [row(read_id=f"r{i}", pos1=rnd.randrange(14), pos2=rnd.randrange(14), strand2=rnd.choice("+-")) for i in range(60)]
    rows += [row(pos1=500 + i, pos2=500 - i) for i in range(30)] + rows[:5]
    got = O.mark_duplicates(frame(spark, *rows, row(pos1=None), row(pos1=None)), ["read_id"])
    assert got.count() == len(rows) + 2 and got.where("is_duplicate").count() == brute(rows)
    assert got.where("is_duplicate AND pos1 IS NULL").count() == 0
    assert O.mark_duplicates(frame(spark), ["read_id"]).count() == 0
    chain = frame(spark, *[row(read_id=f"{i:05d}", pos1=i, pos2=9000 - i) for i in range(3000)])  # one cluster
    assert O.mark_duplicates(chain, ["read_id"]).where("NOT is_duplicate").count() == 1


def test_curves(spark):
    df = frame(spark, row(), row(), row(strand2="-", pos2=1001), row(pos2=1000), row(pos2=900), row(chrom2="chr2"), row(pair_type="DD"))
    got = {r.distance: r for r in O.distance_curves(df, 1500).collect()}
    assert len(got) == 1500 and got[1000].tandem_entry == 2 and got[1].inward == 1 and got[0].inward == 0 and got[7].outward == 0
    assert O.distance_curves(df, 1500, documented=True).where("distance = 1000").first().tandem_exit == 2
    shifted = {(r.kind, r.direction, r.distance): r.n for r in O.raw_and_shifted(frame(spark, row(strand2="-", pos2=1500)), 65).collect()}
    assert shifted["raw", "inward", 500] == 1 and shifted["shifted", "inward", 370] == 1 and len(shifted) == 8000
    f = O.cis_fractions(df).first()
    assert (f.n, f.frac_cis, f.frac_near) == (6, 5 / 6, 1.0)
    w = {r.distance: r for r in O.windowed_distances(frame(spark, row(pos2=1199), row(pos2=1200), row(pos2=1201), row(pos2=1001)), 200, 3).collect()}
    assert [w[d].n for d in range(3)] == [2, 2, 0] and w[0].relative == 1.0
    assert O.windowed_distances(frame(spark), 200, 3).first().relative is None


def test_ends_and_coverage(spark, sizes):
    df = frame(spark, row(pos1=10, pos2=11, strand2="-"), row(pos1=10, pos2=12), row(pos1=-5), row(pos2=1_000_000), row(pos1=10, pos2=65_535), row(pos1=65_536, pos2=65_537))
    ends = O.read_ends(df, sizes)
    assert ends.count() == 8
    runs = {(r.start, r.end, r.depth) for r in O.coverage_runs(ends).collect()}
    assert runs == {(10, 11, 3), (11, 13, 1), (65_535, 65_538, 1)}
    assert {(r.start, r.end) for r in O.coverage_runs(ends, "-").collect()} == {(11, 12)}
    split = O.ends_by_length(O.read_ends(frame(spark, row(pos51=10, pos31=40), row(pos52=60, pos32=0)), sizes, median=True), 60)
    assert {(r.start, r.length, r.length_class) for r in split.collect()} == {(25, 30, "below"), (30, 60, "above")}


def test_heatmap(spark):
    df = frame(spark, row(pos51=100, pos31=130), row(pos51=95, pos31=135, chrom2="chr2", pos52=100, pos32=130), row(pos51=100, pos31=119), row(pos51=200, pos31=230))
    got = {(r.length, r.xbin): r.n for r in O.length_heatmap(df, "chr1", 100, 131, bin_size=10).collect()}
    assert got == {(30, b): 1 for b in range(4)} | {(40, b): 1 for b in range(4)}


def test_tracks(spark):
    sizes = spark.createDataFrame([("c", 1050)], "chrom string, size long")
    track = spark.createDataFrame([("c", 0, 100, 2.0), ("c", 150, 450, 1.0), ("c", 1000, 2000, 4.0)], "chrom string, start long, end long, value double")
    got = [(r.x, r.value) for r in T.bin_track(track, sizes, 200).orderBy("i").collect()]
    assert got == [(0, 1.25), (200, 1.0), (400, 0.25), (600, 0.0), (800, 0.0), (1000, 4.0)]
    assert T.track_limits(T.bin_track(track, sizes, 200)).first().high == 4.0
    assert T.clipped(track, sizes).where("end = 1050").count() == 1
    assert T.renamed_chromosomes(track).first().chrom == "chrc"

    def ranged(*a, **how):
        return sorted(map(tuple, T.track_range(track, sizes, *a, **how).collect()))

    assert ranged("c", 50, 500) == [(50, 100, 2.0), (100, 150, 0.0), (150, 450, 1.0), (450, 500, 0.0)]
    assert ranged("c", 500, 600, default=7.0) == [(500, 600, 7.0)] and ranged("c", 1000, 1050) == [(1000, 1050, 4.0)]
    assert ranged("d", 0, 10) == [(0, 10, None)]


def test_drop_overlaps(spark):
    rnd = random.Random(2)
    rows = [(f"k{rnd.randrange(2)}", s := rnd.randrange(4000), s + rnd.randrange(0, 30), i) for i in range(500)] + [("k0", None, 5, 900)]
    got = {r.id for r in T.drop_overlaps(spark.createDataFrame(rows, "k string, s long, e long, id long"), ["k"], "s", "e", ["e", "id"]).collect()}
    want, last = set(), {}
    for k, s, e, i in sorted((r for r in rows if r[1] is not None and r[1] < r[2]), key=lambda r: (r[1], r[2], r[3])):
        if s >= last.get(k, -1):
            want.add(i)
            last[k] = e
    assert got == want
    chain = spark.createDataFrame([("a", i, i + 3, i) for i in range(1000)], "k string, s long, e long, id long")  # one period that overlaps throughout
    for width in (7, 1 << 22):
        assert sorted(r.id for r in T.drop_overlaps(chain, ["k"], "s", "e", ["e", "id"], cell_width=width).collect()) == list(range(0, 1000, 3))
    assert T.drop_overlaps(chain.limit(0), ["k"], "s", "e", ["e", "id"]).isEmpty()


PAIRS = "\n".join([
    "## pairs format v1.0", "#samheader: @SQ SN:chr1", "#columns: readID chrom1 pos1 chrom2 pos2 strand1 strand2 pair_type sam1 sam2 mapq1 mapq2",
    "a\tchr1\t10\tchr1\t300\t+\t-\tUU\tx#y\"z\tw\t3\t4", "b\t!\t.\tchr1\t5\t-\t+\tNU\t\"q\tw\t0\t60",
]) + "\n"


def test_text_sources(spark, folder):
    def put(name, text):
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)
        return f"{folder}/{name}"

    path = put("x.pairs", PAIRS)
    assert S.pairs_columns(spark, path)[:3] == ["readID", "chrom1", "pos1"]
    rows = S.read_pairs(spark, path).collect()
    assert [(r.read_id, r.pos1, r.sam1, r.mapq2) for r in rows] == [("a", 10, 'x#y"z', 4), ("b", None, '"q', 60)]
    for text, message in (("chr1\t5\n#columns: a\n", "names no columns"), ("#a\n", "no records"), ("", "no records")):
        with pytest.raises(ValueError, match=message):
            S.pairs_columns(spark, put("bad.pairs", text))
    loose = S.read_pairs(spark, put("loose.pairs", "#columns: readID chrom1 pos1\n a  chr1 \t 7\n\nb chr2\n")).collect()
    assert [tuple(r) for r in loose] == [("a", "chr1", 7), ("b", "chr2", None)]
    S.write_pairs(S.read_pairs(spark, path), f"{folder}/again", ["## pairs format v1.0"])
    assert S.pairs_columns(spark, f"{folder}/again") == S.pairs_columns(spark, path)
    assert sorted(S.read_pairs(spark, f"{folder}/again").collect()) == sorted(S.read_pairs(spark, path).collect())
    files = sorted(f for f in os.listdir(f"{folder}/again") if f.startswith("part"))
    assert open(f"{folder}/again/{files[0]}").read().startswith("## pairs format v1.0\n#columns: readID chrom1")
    assert S.parse_region("chr8:84,900,000-85,800,000") == ("chr8", 84_900_000, 85_800_000)
    with pytest.raises(ValueError):
        S.parse_region("chr8")
    assert [tuple(r) for r in S.read_bed(spark, put("r.bed", "c\t1\t5\tname\t0\nc\t7\t9\n")).collect()] == [("c", 1, 5), ("c", 7, 9)]
    gtf = S.read_gtf(spark, put("g.gtf", '#c\nchr1\tsrc\tgene\t5\t90\t.\t+\t.\tgene_id "G1"; gene_name "Abc"; tag a, b; flag; empty "";\n'
                                         "chr1\tsrc\ttranscript\t5\t90\tNA\t-\t0\ttranscript_id=T1;gene_id=.\n"))  # fmt: skip
    a, b = gtf.collect()
    assert (a.seqname, a.start, a.end, a.score, a.strand) == ("chr1", 5, 90, None, "+") and b.score is None
    assert a.attrs == {"gene_id": ["G1"], "gene_name": ["Abc"], "tag": ["a", "b"], "INFO4": ["flag"], "empty": None}
    assert b.attrs == {"transcript_id": ["T1"], "gene_id": None}
    genes = T.genes_in_region(gtf, "chr1", 50, 200, ["Abc"]).collect()
    assert [(g.label, g.start, g.end, g.highlight) for g in genes] == [("Abc", 50, 90, True)]
    assert [g.label for g in T.genes_in_region(gtf.where("feature <> 'gene'"), "chr1", 0, 9).collect()] == ["T1"]
    wig = put("t.wig", "browser\ntrack name=a\n1 2\ntrack name=b\n 3 4 \n5 6\ntrack name=bb\n7\n")
    assert [r.line for r in S.select_wig_track(spark, wig, "name=b").collect()] == ["3 4", "5 6"]
    assert [r.line for r in S.select_wig_track(spark, wig).collect()] == ["1 2"] and S.select_wig_track(spark, wig, "zz").count() == 0
    put("b.bg", "c\t1\t2\t3\n")
    assert list(S.find_tracks(spark, folder)) == ["b.bg"] and S.read_bedgraph(spark, f"{folder}/b.bg").first().value == 3.0
    tab = S.table_to_bedgraph(S.read_table(spark, put("x.gtab.txt", "Chromosome\tStart\tEnd\tp\nc\t1\t2\t0.5\n")), "p")
    assert tuple(tab.first()) == ("c", 1, 2, 0.5)


def test_store_and_map(spark, folder):
    sizes = spark.createDataFrame([("a", 2000), ("b", 900)], "chrom string, size long")
    for res in (200, 400):
        bins = M.make_bins(sizes, res).withColumn("weight", F.lit(2.0))
        pairs = spark.range(500).select(F.lit("a").alias("chrom1"), (F.col("id") * 3 + 1).alias("pos1"), F.lit("a").alias("chrom2"), (F.col("id") * 3 + 201).alias("pos2"))
        api.save_store(bins, M.count_pixels(pairs, bins, res), f"{folder}/store", res)
    assert S.resolutions(spark, f"{folder}/store/bins") == [200, 400]
    assert api.add_neighbor_weights(spark, f"{folder}/store", 200) == [200, 400]
    m = api.ContactMap.from_store(spark, f"{folder}/store", 200, "a:400-1,200", balance=False)
    assert m.cells.count() == 10 and m.cells.agg(F.max("j")).first()[0] == 3
    w = api.ContactMap.from_store(spark, f"{folder}/store", 200, "a:400-1,200")
    assert w.cells.agg(F.sum("v")).first()[0] == 4 * m.cells.agg(F.sum("v")).first()[0]
    nb = api.ContactMap.from_store(spark, f"{folder}/store", 200, "a:400-1,200", balance="weight_neighbor")
    assert nb.cells.where("v IS NOT NULL").count() > 0
    with pytest.raises(ValueError):
        api.ContactMap.from_store(spark, f"{folder}/store", 300, "a:0-900")
    m.save(f"{folder}/map", note="x")
    again = api.ContactMap.load(spark, f"{folder}/map")
    assert again.comparable(m) and sorted(again.cells.collect()) == sorted(m.cells.collect())
    assert m.coarsen(2).end == 1200 and m.select_region(600, 1000).cells.count() == 3 and m.marginal().count() == 4
    assert m.compare(again).where("v <> 0").count() == 0 and m.merged(again).count() == 16
    with pytest.raises(ValueError):
        m.compare(m.select_region(600, 1000))


def test_commands(spark, folder):
    with open(f"{folder}/x.pairs", "w") as f:
        f.write(PAIRS)
    with open(f"{folder}/sizes", "w") as f:
        f.write("chr1\t1000\n")

    def run(*args):
        cli.main(list(args), spark)

    run("shift-pairs", f"{folder}/x.pairs", f"{folder}/shifted")
    assert [r.pos1 for r in S.read_pairs(spark, f"{folder}/shifted").orderBy("read_id").collect()] == [75, None]
    run("merge-pairs", f"{folder}/both", f"{folder}/x.pairs", f"{folder}/shifted")
    assert S.read_pairs(spark, f"{folder}/both").count() == 4
    run("filter-pairs", f"{folder}/sizes", f"{folder}/x.pairs", f"{folder}/kept.parquet", "--direction", "inward")
    assert spark.read.parquet(f"{folder}/kept.parquet").count() == 1
    run("base-ps", f"{folder}/x.pairs", "--max-distance", "400", "--output", f"{folder}/ps")
    assert spark.read.csv(f"{folder}/ps", header=True).where("inward = 1").first().distance == "290"
    run("bin-pairs", f"{folder}/sizes", f"{folder}/kept.parquet", f"{folder}/store")
    run("remove-inward", f"{folder}/store", f"{folder}/store", f"{folder}/without")
    assert S.read_store(spark, f"{folder}/without/pixels", 200).first()["count"] == 0
    run("bin-pairs", f"{folder}/sizes", f"{folder}/kept.parquet", f"{folder}/store2")
    run("merge-maps", f"{folder}/sum", f"{folder}/store", f"{folder}/store2")
    assert S.read_store(spark, f"{folder}/sum/pixels", 200).first()["count"] == 2
    run("pairs-to-bed", f"{folder}/sizes", f"{folder}/x.pairs", f"{folder}/bed")
    assert spark.read.text(f"{folder}/bed").count() == 2
    assert os.path.exists(f"{folder}/bed")


def test_stream_windows(spark, folder):
    import datetime as dt

    day = dt.datetime(2031, 3, 1, 5)
    frame(spark, row(loaded_at=day), row(loaded_at=day), row(loaded_at=day + dt.timedelta(days=1), run="b"), row(loaded_at=None)).write.parquet(f"{folder}/in")
    counts = ST.loads_per_window(ST.stream_pairs(spark, f"{folder}/in", frame(spark).schema))
    query = counts.writeStream.format("memory").queryName("loads").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.run, r.n) for r in spark.table("loads").collect() if r.window) == [("a", 2), ("b", 1)]


def test_stream(spark, sizes, folder):
    df = frame(spark, row(strand2="-"), row(), row(pair_type="DD"))
    df.write.parquet(f"{folder}/in")
    stream = ST.shifted_valid(ST.stream_pairs(spark, f"{folder}/in", df.schema), sizes, 65, direction="inward")
    ST.append_to(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    assert [(r.pos1, r.pos2) for r in spark.read.parquet(f"{folder}/out").collect()] == [(1065, 1935)]
