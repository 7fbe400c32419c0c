import glob
import gzip
import os

import pytest
from pyspark.sql import functions as F

from sketchloom import session
from sketchloom.__main__ import main
from sketchloom.functions.seq import portable_hash
from sketchloom.operators import cluster, maintenance, multik, profile, similarity, sketch, taxonomy
from sketchloom.operators.sketch import SketchSpec
from sketchloom.plans import flows
from sketchloom.sources import profiles, results, sequences, sketchdb
from tests.conftest import dna, flip, grams, sets

PROFILE = """#CAMI Submission
@SampleID:x
@@TAXID\tRANK\tTAXPATH\tTAXPATHSN\tPERCENTAGE

2\tsuperkingdom\t2\tBacteria\t60
10\tphylum\t2|10\tBacteria|P\t40
11\tgenus\t2|99|11\tBacteria|gone|G\t10
11\tgenus\t2|99|11\tBacteria|gone|G\t5
12\tspecies\t2|10||12\tBacteria|P||S\t30
7\tphylum\t98|7\tlost|L\t40
"""


def text(path):
    return "".join(open(f).read() for f in sorted(glob.glob(f"{path}/part-*")))


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first > record\nACGT\nAC\n\n>two\r\nGGTT\r\n>empty\n")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as out:
        out.write(">three\nTTTT\n")
    (tmp_path / "c.fastq").write_text("@r1\nACGT\n+\nIIII\n@r2 x\nGGCC\n+r2\n@@@I\n@r3\nTT\n+\n@I\n")
    rows = sequences.read_sequences(spark, [str(tmp_path / f) for f in ("a.fa", "b.fa.gz", "c.fastq")]).collect()
    got = sorted((r["name"], r["record"], r["seq"]) for r in rows)
    assert got == [
        ("a.fa", "empty", ""),
        ("a.fa", "one first > record", "ACGTAC"),
        ("a.fa", "two", "GGTT"),
        ("b.fa.gz", "three", "TTTT"),
        ("c.fastq", "r1", "ACGT"),
        ("c.fastq", "r2 x", "GGCC"),
        ("c.fastq", "r3", "TT"),
    ]
    (tmp_path / "list").write_text(f"{tmp_path}/c.fastq\n\n{tmp_path}/a.fa\n")
    assert [os.path.basename(p) for p in sequences.read_file_list(spark, str(tmp_path / "list"))] == ["a.fa", "c.fastq"]
    (tmp_path / "list").write_text(f"{tmp_path}/nope.fa\n")
    with pytest.raises(FileNotFoundError):
        sequences.read_file_list(spark, str(tmp_path / "list"))


def test_concatenated_reference_and_fasta_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, "ACGTACGT"), ("a", 1, "GG"), ("b", 0, "TTTTT")], "name string, at int, seq string")
    parts = sorted((r["name"], r["at"], r["part"], r["text"]) for r in sequences.concatenated_reference(rows, spacer="NN", step=3).collect())
    joined = {}
    for name, _, _, piece in parts:
        joined[name] = joined.get(name, "") + piece
    assert joined == {"a": "NNACGTACGTNNGG", "b": "NNTTTTT"}
    records = spark.createDataFrame(
        [("c1", "L", "a", "r1", "AC"), ("c1", "L", "b", "r2", "GT"), ("c2", "M", "c", "r3", "TT")],
        "cluster string, lca string, name string, record string, seq string",
    )
    sequences.write_cluster_fastas(records, str(tmp_path / "clusters"))
    body = text(tmp_path / "clusters" / "folder=L_c1")
    assert sorted(body.split()[::2]) == [">L_0", ">L_1"] and sorted(body.split()[1::2]) == ["AC", "GT"]
    sequences.write_kmer_fasta(spark.createDataFrame([("AC",), ("AC",), ("GT",)], "kmer string"), str(tmp_path / "k"))
    lines = text(tmp_path / "k").split()
    assert len(set(lines[::2])) == 2 and sorted(lines[1::2]) == ["AC", "GT"]


def test_profiles(spark, tmp_path):
    (tmp_path / "p").write_text(PROFILE)
    frame = profiles.read_profile(spark, str(tmp_path / "p"))
    got = {r["tax_id"]: (r["ancestor"], r["branch_length"], r["abundance"], "|".join(r["tax_path"])) for r in frame.collect()}
    assert got == {
        "2": ("-1", 1, 60.0, "2"),
        "10": ("2", 1, 40.0, "2|10"),
        "11": ("2", 2, 15.0, "2||11"),
        "12": ("10", 2, 30.0, "2|10||12"),
        "7": ("-1", 2, 40.0, "|7"),
    }
    own = {r["tax_id"]: r["abundance"] for r in profile.subtract_down(frame).collect()}
    assert own == {"2": 5.0, "10": 10.0, "11": 15.0, "12": 30.0, "7": 40.0}
    whole = {r["tax_id"]: r["abundance"] for r in profile.normalize(frame).collect()}
    assert whole == {"2": 60.0, "10": 40.0, "11": 15.0, "12": 30.0, "7": 40.0}
    cut = {r["tax_id"]: r["abundance"] for r in profile.threshold(frame, 35).collect()}
    assert cut["11"] == 0 and cut["10"] == 40
    other = frame.where("tax_id in ('2', '10')")
    merged = {r["tax_id"]: r["abundance"] for r in profile.merge(frame, other).collect()}
    assert merged["2"] == 120 and merged["7"] == 40
    nodes = {r["tax_id"]: r for r in profile.unifrac_input(frame, other).collect()}
    assert sorted(r["node"] for r in nodes.values()) == list(range(6)) and nodes["-1"]["node"] == 5
    assert nodes["12"]["node"] == 0 and nodes["12"]["ancestor_node"] == nodes["10"]["node"]
    assert sum(r["p"] for r in nodes.values()) == pytest.approx(1) and nodes["10"]["q"] == pytest.approx(40 / 60)
    profiles.write_profile(frame, str(tmp_path / "out"), "s")
    body = text(tmp_path / "out").split("\n")
    assert "@SampleID:s" in body and body[6] == "2\tsuperkingdom\t2\tBacteria\t60.000000"
    again = profiles.read_profile(spark, str(tmp_path / "out"))
    assert sorted((r["tax_id"], r["ancestor"], r["abundance"]) for r in again.collect()) == sorted(
        (k, v[0], v[2]) for k, v in got.items()
    )
    (tmp_path / "bad").write_text("@@TAXID\tRANK\n1\tx\n")
    with pytest.raises(ValueError):
        profiles.read_profile(spark, str(tmp_path / "bad"))


def test_taxonomy(spark, tmp_path):
    (tmp_path / "tax").write_text("a 1_org 1 k__2_Bact|p__9_Some_Phyl\nb 3_org 3 k__2_Bact|p__2_x\n")
    table = profiles.read_taxonomy(spark, str(tmp_path / "tax"))
    hits = spark.createDataFrame([("a", 0.5), ("b", 0.1), ("c", 0.9)], "name string, `k=5` double")
    with pytest.raises(KeyError):
        taxonomy.profile_from_results(hits, table, "k=5", 0.0)
    rows = taxonomy.profile_from_results(hits, table, "k=5", 0.0, strict=False).collect()
    got = sorted((r["tax_id"], r["rank"], "|".join(r["tax_path"]), "|".join(r["tax_path_sn"])) for r in rows)
    # b's second level repeats the id of its first one and is left out.
    assert got == [("2", "superkingdom", "2", "Bact"), ("9", "phylum", "2|9", "Bact|Some Phyl")]
    (tmp_path / "tax2").write_text("a 1 1 k__2_B\na 1 1 k__2_B\n")
    with pytest.raises(ValueError):
        profiles.read_taxonomy(spark, str(tmp_path / "tax2"))
    (tmp_path / "truth").write_text("@x\n2\tsuperkingdom\n9\tphylum\n8\tphylum\n")
    real = profiles.read_truth(spark, str(tmp_path / "truth"))
    said = spark.createDataFrame([("k", "2", 0.5), ("p", "9", 0.2), ("p", "7", 0.4)], "rank string, tax_id string, score double")
    scored = {(r["rank"], r["threshold"]): (r["tp"], r["fp"], r["fn"]) for r in taxonomy.score_thresholds(said, real, [0.0, 0.2, 0.45]).collect()}
    assert scored[("p", 0.0)] == (1, 1, 1) and scored[("p", 0.2)] == (0, 1, 2) and scored[("k", 0.45)] == (1, 0, 0)
    lineage = spark.createDataFrame([("f", "Bact|A phyl||", "2|9||")], "name string, names string, ids string")
    row = taxonomy.repath(lineage).first()
    assert (row["organism"], row["tax_id"], row["path"]) == ("9_A_phyl", "9", "k__2_Bact|p__9_A_phyl|")


def test_result_files(spark, tmp_path):
    frame = spark.createDataFrame([("a", 0.5, 0.25)], "name string, `k=3` double, `k=5` double")
    results.write_results(frame, str(tmp_path / "r"))
    assert results.read_results(spark, str(tmp_path / "r")).collect() == frame.collect()
    found = spark.createDataFrame([("a", 3, 0, "ACG")], "name string, k int, slot int, prefix string")
    results.write_matches(found, str(tmp_path / "m"))
    assert results.read_matches(spark, str(tmp_path / "m")).collect() == found.collect()
    results.write_grams(spark.createDataFrame([("ACG",)], "kmer string"), str(tmp_path / "g"), 3)
    assert results.read_grams(spark, str(tmp_path / "g"), 3).count() == 1
    with pytest.raises(ValueError):
        results.read_grams(spark, str(tmp_path / "g"), 4)


def test_command_line(spark, rng, tmp_path):
    genomes = {f"g{i}.fna": dna(rng, 900) for i in range(3)}
    for name, body in genomes.items():
        (tmp_path / name).write_text(f">{name}\n{body}\n")
    (tmp_path / "list").write_text("".join(f"{tmp_path}/{n}\n" for n in reversed(genomes)))
    reads = [genomes["g0.fna"][at : at + 120] for at in range(0, 800, 60)] + [flip(genomes["g1.fna"][100:500])]
    (tmp_path / "q.fa").write_text("".join(f">r{i}\n{r}\n" for i, r in enumerate(reads)))
    db, q = str(tmp_path / "db"), str(tmp_path / "q.fa")
    main(["train-multi", "-n", "100", "-k", "15", "-r", "9-15-3", str(tmp_path / "list"), db], spark)
    outs = {}
    for tag, more in (("specific", []), ("sensitive", ["--sensitive"])):
        main(["query-multi", "-c", "0.2", *more, q, db, str(tmp_path / tag), "9-40-3"], spark)
        outs[tag] = results.read_results(spark, str(tmp_path / tag)).collect()
    assert [r["name"] for r in outs["sensitive"]] == ["g0.fna", "g1.fna"]
    assert outs["sensitive"][0].asDict().keys() == {"name", "k=9", "k=12", "k=15"}
    assert outs["specific"][0]["k=15"] > 0.8
    main(["truth", "-c", "0.2", q, db, str(tmp_path / "truth"), "9-15-3"], spark)
    exact = results.read_results(spark, str(tmp_path / "truth")).collect()
    inside = {min(g, flip(g)) for r in reads for g in grams(r, 15)}
    own = {min(g, flip(g)) for g in grams(genomes["g0.fna"], 15)}
    assert exact[0]["k=15"] == pytest.approx(len(own & inside) / len(own))
    assert abs(exact[0]["k=15"] - outs["sensitive"][0]["k=15"]) < 0.15

    one = str(tmp_path / "one")
    main(["train", "-n", "100", "-k", "15", "-i", str(tmp_path / "list"), one], spark)
    main(["query", "-ct", "0.2", "-b", q, one, str(tmp_path / "r1")], spark)
    main(["query", "-ct", "0.2", "-b", "-i", q, one, str(tmp_path / "r2")], spark)
    main(["sample", "-k", "15", q, str(tmp_path / "s")], spark)
    main(["query", "-ct", "0.2", "-b", "-ng", str(tmp_path / "s"), q, one, str(tmp_path / "r3")], spark)
    first, second, third = (results.read_results(spark, str(tmp_path / r)).collect() for r in ("r1", "r2", "r3"))
    assert first == third and [r["name"] for r in first] == [r["name"] for r in second] == ["g0.fna", "g1.fna"]
    with pytest.raises(SystemExit):
        main(["train", "-k", "40", "x", "y"], spark)

    main(["prefilter", one, "9-15-3"], spark)
    (tmp_path / "tax").write_text("".join(f"{n} 1_o {i} k__2_B|s__{i + 10}_sp\n" for i, n in enumerate(genomes)))
    main(["profile", "-t", str(tmp_path / "tax"), "-c", str(tmp_path / "sensitive"), "-o", str(tmp_path / "prof")], spark)
    assert "10\tspecies\t2|10\tB|sp\t0.010000" in text(tmp_path / "prof")


def test_formats_are_told_by_content(spark, tmp_path):
    (tmp_path / "reads").write_text("\n@r1\nACGT\n+\nACGT\n")
    (tmp_path / "looks.fq").write_text(">s\nGGTT\n")
    with gzip.open(tmp_path / "packed.gz", "wt") as out:
        out.write("@r2\nTTAA\n+\nIIII\n")
    (tmp_path / "nothing.fa").write_text("")
    rows = sequences.read_sequences(spark, str(tmp_path)).collect()
    assert sorted((r["name"], r["record"], r["seq"]) for r in rows) == [
        ("looks.fq", "s", "GGTT"),
        ("packed.gz", "r2", "TTAA"),
        ("reads", "r1", "ACGT"),
    ]
    (tmp_path / "other.txt").write_text("hello\n")
    with pytest.raises(ValueError, match="other.txt"):
        sequences.read_sequences(spark, str(tmp_path / "*"))


def test_a_compressed_file_is_dealt_out(spark, rng, tmp_path):
    with gzip.open(tmp_path / "big.fq.gz", "wt") as out:
        for k in range(20_000):
            out.write(f"@r{k}\n{dna(rng, 100)}\n+\n{'I' * 100}\n")
    rows = sequences.read_sequences(spark, str(tmp_path / "big.fq.gz"))
    sizes = [r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) < 2 * min(sizes)


def test_names_must_be_unique(spark, rng, tmp_path):
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "s.fna").write_text(f">s\n{dna(rng, 300)}\n")
    (tmp_path / "list").write_text(f"{tmp_path}/x/s.fna\n{tmp_path}/y/s.fna\n")
    with pytest.raises(ValueError, match="s.fna"):
        sequences.read_file_list(spark, str(tmp_path / "list"))
    both = sequences.read_sequences(spark, [f"{tmp_path}/x/s.fna", f"{tmp_path}/y/s.fna"])
    with pytest.raises(Exception, match="two files are named s.fna"):
        maintenance.build(both, SketchSpec(n=10, ksize=5)).meta.collect()


def test_a_database_knows_its_hash(spark, rng, tmp_path):
    first, second = sets(spark, {"a": dna(rng, 200)}), sets(spark, {"b": dna(rng, 200)})
    fast, portable = SketchSpec(n=10, ksize=5), SketchSpec(n=10, ksize=5, hasher=portable_hash)
    sketchdb.export_database(maintenance.build(first, fast), str(tmp_path / "db"))
    db = sketchdb.import_database(spark, str(tmp_path / "db"))
    assert db.meta.first()["hash"] == "fast_hash" and db.meta.first()["both_strands"] is False
    with pytest.raises(ValueError, match="fast_hash"):
        maintenance.insert(db, second, portable)
    with pytest.raises(ValueError):
        maintenance.union(db, maintenance.build(second, portable)).meta.collect()
    assert maintenance.insert(db, second, fast).meta.count() == 2


def test_sets_without_a_shingle_stay(spark):
    docs = sets(spark, {"a": "ACGTACGTAC", "tiny": "AC"})
    spec = SketchSpec(n=10, ksize=5)
    entries, names = sketch.bottom_n(docs, spec), docs.select("name")
    found = multik.matches_once(sets(spark, {"q": "ACGTACG"}), entries, [3, 5], 5)
    rows = {(r["name"], r["k"]): (r["hits"], r["denom"], r["ci"]) for r in multik.containment(found, entries, [3, 5], names).collect()}
    assert rows["tiny", 3] == rows["tiny", 5] == (0, 0, 0.0) and rows["a", 5][2] > 0
    focal = sketch.bottom_n(sets(spark, {"q": "ACGTACG"}), spec)
    assert {r["name"]: r["common"] for r in similarity.common(focal, entries, 10, names).collect()}["tiny"] == 0
    placed = {r["name"]: r["cluster"] for r in cluster.cluster_sketches(entries, 10, names=names).collect()}
    assert placed == {"a": "a", "tiny": "tiny"}
    clusters = spark.createDataFrame([("a", "a"), ("tiny", "a")], "name string, cluster string")
    with pytest.raises(KeyError, match="tiny"):
        cluster.common_ancestors(clusters, spark.createDataFrame([("a", "k__x")], "name string, path string"))


def test_an_index_that_does_not_fit_is_refused(spark, rng, tmp_path):
    (tmp_path / "g.fna").write_text(f">g\n{dna(rng, 300)}\n")
    (tmp_path / "list").write_text(f"{tmp_path}/g.fna\n")
    db = str(tmp_path / "db")
    main(["train-multi", "-n", "50", "-k", "12", "-r", "6-12-3", str(tmp_path / "list"), db], spark)
    with pytest.raises(ValueError, match="lengths"):
        flows.load_index(spark, db, [5, 9])
    assert flows.load_index(spark, str(tmp_path / "elsewhere"), [6, 9]) is None


class _Session:
    """A session's settings, for the folder's rule alone."""

    def __init__(self, master, folder):
        self.conf = {"spark.sql.warehouse.dir": folder}
        self.sparkContext = self
        self.master = master

    def getConf(self):
        return {}


def test_scratch_folder(spark):
    assert session.scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert session.scratch_dir(_Session("local[2]", "file:/w")) == "file:/w/scratch"
    assert session.scratch_dir(_Session("yarn", "hdfs://h/w")) == "hdfs://h/w/scratch"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_dir(_Session("yarn", "file:/w"))
