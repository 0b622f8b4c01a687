import json

import pytest
from pyspark.sql import functions as F

from trellica.__main__ import main
from trellica.functions.certificate import certificate, framed_sha256, parameters
from trellica.functions.scoring import EDIT, Matrix, Scoring
from trellica.operators.align import align, with_operations
from trellica.sources import reports, sequences, sink
from trellica.streaming.align_stream import align_stream, status_by_window

PAIR = "pair_index long, query_id string, query string, target_id string, target string"


def records(spark, text, name="file:/x/reads.fa"):
    return [(r["idx"], r["id"], r["seq"]) for r in sequences.parse(spark.createDataFrame([(name, text)], "source string, text string")).orderBy("idx").collect()]


def test_formats(spark):
    assert records(spark, "\n>q1 \nac\nGT\n>q2 description\nTT\n>\nA\n") == [(0, "q1", "ACGT"), (1, "q2", "TT"), (2, "record_3", "A")]
    assert records(spark, "@r1 x\nac\n+\nII\n\n@r2\nGG\n+\nI\n") == [(0, "r1", "AC"), (1, "r2", "GG")]
    assert records(spark, "ac gt\n") == [(0, "reads", "ACGT")]
    for bad in (">q\nACé\n", "@r\nAC\n+\n", "@r\nAC\nx\nII\n"):
        with pytest.raises(Exception, match=r"ASCII|FASTQ"):
            records(spark, bad)


def test_read_and_zip(spark, tmp_path):
    (tmp_path / "q.fa").write_text(">q1\nACGT\n>q2\nAAAA\n")
    (tmp_path / "t.fa").write_text(">t1\nACGT\n>t2\nTTTT\n")
    both = sequences.zip_pairs(*[sequences.read_sequences(spark, str(tmp_path / f"{x}.fa")) for x in "qt"])
    assert [r["distance"] for r in align(both).orderBy("pair_index").collect()] == [0, 4]
    with pytest.raises(ValueError):
        sequences.read_sequences(spark)
    with pytest.raises(Exception, match="unequal"):
        sequences.zip_pairs(sequences.read_sequences(spark, str(tmp_path / "q.fa")), sequences.read_sequences(spark, inline="AC")).collect()
    assert sequences.dna(spark, 6).first()["seq"] == "TGCATG"


def test_reports(spark):
    df = spark.createDataFrame([(0, "q\t1", "TTAC", "t1", "AC"), (1, "q2", "AC", "t2", "ACC")], PAIR)
    local = align(df, "local-linear", Scoring())
    assert reports.sam(local).orderBy("pair_index").first()["value"].split("\t")[:6] == ["q 1", "0", "t1", "1", "255", "2S2="]
    assert [r["value"] for r in reports.sam_header(local).orderBy("place").collect()] == ["@HD\tVN:1.6\tSO:unknown", "@SQ\tSN:t1\tLN:2", "@SQ\tSN:t2\tLN:3"]
    edit = align(df, "edit-distance", engine="blocks")
    paf = reports.paf(edit).orderBy("pair_index").collect()[1]["value"].split("\t")
    assert paf[:12] == ["q2", "2", "0", "2", "+", "t2", "3", "0", "3", "2", "3", "255"] and "NM:i:1" in paf and "pi:i:1" in paf
    lines = [json.loads(r["value"]) for r in reports.json_lines(with_operations(edit, "summary")).orderBy("pair_index").collect()]
    assert lines[0]["score"] is None and "error" not in lines[0] and "backend" not in lines[0] and lines[0]["operation_counts"][0]["op"]
    assert len(reports.tsv(edit).first()["value"].split("\t")) == len(reports.TSV_FIELDS)
    assert "distance: 2" in reports.text(edit).orderBy("pair_index").first()["value"] and reports.cigar_table(edit).count() == 2
    with pytest.raises(Exception, match="needs a path"):
        reports.paf(align(df, "edit-distance", score_only=True)).collect()
    assert reports.all_sound(edit).first()["sound"] is True
    assert reports.all_sound(align(spark.createDataFrame([(0, "q", None, "t", "A")], PAIR))).first()["sound"] is False


def test_certificates(spark):
    df = spark.createDataFrame([(0, "q", "AC", "t", "A"), (1, "q", "AC", "t", "A"), (2, "q", "AC", "t", "C")], PAIR)
    out = [r["c"]["certificate_sha256"] for r in align(df).select("pair_index", certificate("{}").alias("c")).orderBy("pair_index").collect()]
    assert out[0] == out[1] != out[2]
    bare = align(df, score_only=True).select(certificate("{}").alias("c")).first()["c"]
    assert bare["trace_sha256"] is None and len(bare["certificate_sha256"]) == len(bare["result_sha256"]) == 64
    two = spark.range(1).select(framed_sha256(F.lit("ab"), F.lit("c")).alias("x"), framed_sha256(F.lit("a"), F.lit("bc")).alias("y")).first()
    assert two["x"] != two["y"]


def test_streaming(spark, tmp_path):
    rows = [(i, f"q{i}", "ACGT", f"t{i}", "ACCT", f"2024-01-01 00:0{i}:00") for i in range(3)]
    spark.createDataFrame(rows, PAIR + ", ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    query = align_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), keep=("ts",), trigger="1 second")
    query.processAllAvailable()
    query.stop()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["pair_index"], r["distance"]) for r in out.collect()) == [(0, 1), (1, 1), (2, 1)]
    windows = status_by_window(spark.readStream.schema(out.schema).parquet(str(tmp_path / "out")), "ts", "5 minutes", "1 minute")
    query = windows.writeStream.format("memory").queryName("status").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r)[1:] for r in spark.sql("SELECT * FROM status").collect()] == [("path_only", 3)]


def test_generators(spark):
    assert sequences.series(spark, 3).first()["series"] == [(17 * i + 11) % 31 - 15 + i % 7 - 3 for i in range(3)]
    assert sequences.series(spark, 3, 2).first()["series"] == [(13 * i + 5) % 29 - 14 + i % 5 - 2 for i in range(2, 5)]
    assert sequences.repeated(spark, "ACG", 7).first()["seq"] == "ACGACGA"
    assert sequences.mutated(sequences.repeated(spark, "ACGT", 8), [0, 3, 20]).first()["seq"] == "CCGAACGT"


def test_status_counts(spark):
    df = spark.createDataFrame([(0, "q", "AC", "t", "A"), (1, "q", None, "t", "A"), (2, "q", "AC", "t", "C")], PAIR)
    assert {r["status"]: r["n"] for r in reports.status_counts(align(df)).collect()} == {"path_only": 2, "failed": 1}


def test_fasta_in_splits_equals_whole_files(spark, tmp_path):
    texts = [
        ">a x\nACGT\nAC\n>b\nGG\n" * 9,
        "\n\n>c\r\nAC\r\nGT\r\n>\r\nTT\r\n",
        ">only\n" + "ACGT\n" * 50,
        " >d\nA>C\n>\n>e",
    ]
    for i, text in enumerate(texts):
        (tmp_path / f"f{i}.fa").write_bytes(text.encode())
    want = sorted((r["source"][-5:], r["idx"], r["id"], r["seq"]) for r in sequences.read_sequences(spark, str(tmp_path)).collect())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("40", "150", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = sorted((r["source"][-5:], r["idx"], r["id"], r["seq"]) for r in sequences.read_fasta(spark, str(tmp_path)).collect())
            assert got == want
        (tmp_path / "bad.fa").write_text("ACGT")
        with pytest.raises(Exception, match="starts with"):
            sequences.read_fasta(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_fastq_in_splits_and_mixed_folders_equal_whole_files(spark, tmp_path):
    record = lambda i, end="\n": f"@r{i} x{end}ac{'g' * (i % 7)}t{end}+{end}II@I{end}" + ("\n \t\n" if i % 3 == 0 else "")
    files = {"a.fq": "".join(map(record, range(60))), "b.fq": "\n\n" + "".join(record(i, "\r\n") for i in range(9)), "c.fq": record(1).rstrip("\n")}
    (tmp_path / "fq").mkdir()
    (tmp_path / "mixed").mkdir()
    for name, text in files.items():
        (tmp_path / "fq" / name).write_bytes(text.encode())
    for name, text in {"a.fq": files["a.fq"], "odd name.fa": " \n>x\nAC\n>\nGT\n", "r.txt": "\nac\n@gt\n"}.items():
        (tmp_path / "mixed" / name).write_text(text)
    told = lambda df: sorted((r["source"][-4:], r["idx"], r["id"], r["seq"]) for r in df.collect())
    want, both = (told(sequences.read_sequences(spark, str(tmp_path / d))) for d in ("fq", "mixed"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("30", "170", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert told(sequences.read_fastq(spark, str(tmp_path / "fq"))) == want
            assert [x[1:] for x in told(sequences.read_records(spark, str(tmp_path / "mixed")))] == [x[1:] for x in both]
        for bad, message in (("@r\nAC\n+\n", "four lines"), ("@r\nAC\nx\nII\n", "needs @")):
            (tmp_path / "bad.fq").write_text(bad)
            with pytest.raises(Exception, match=message):
                sequences.read_fastq(spark, str(tmp_path / "bad.fq")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_report_files(spark, tmp_path):
    rows = [(i, f"q{i}", "ACGT" * (i % 3 + 1), f"t{i}", "ACCT" * (i % 3 + 1)) for i in range(40)]
    done = align(spark.createDataFrame(rows, PAIR), "edit-distance")
    for form in ("tsv", "cigar", "text", "json", "paf", "sam"):
        path = tmp_path / form
        assert sink.write_report(done, str(path), form) == {"full": 0, "path_only": 40, "score_only": 0, "failed": 0}
        text = "".join(p.read_text() for p in sorted(path.glob("part-*")))
        want = sorted((r["place"], r["value"]) for r in sink.lines(done, form).collect())
        assert text == "".join(v + "\n" for _, v in want)
        assert form not in ("tsv", "sam") or text.startswith(("pair_index\t", "@HD\t"))
    with pytest.raises(Exception, match="exists"):
        sink.write_report(done, str(tmp_path / "tsv"), "tsv")
    bad = align(spark.createDataFrame([*rows, (99, "q", None, "t", "A")], PAIR), "edit-distance")
    assert sink.exit_status(sink.write_report(bad, str(tmp_path / "bad.tsv"), "tsv")) == 1 and sink.exit_status({"failed": 0}) == 0
    for batch in (bad, align(spark.createDataFrame(rows, PAIR), "edit-distance", score_only=True)):
        with pytest.raises(ValueError, match="cannot hold"):
            sink.write_report(batch, str(tmp_path / "never"), "paf")
        assert not (tmp_path / "never").exists()
    with pytest.raises(ValueError, match="form"):
        sink.write_report(done, str(tmp_path / "never"), "x")


def test_parameter_text():
    m = Matrix("m", "AC", ((1, 0), (0, 1)))
    assert parameters("edit-distance", EDIT) == '{"kind":"edit-distance","substitution":1,"insertion":1,"deletion":1}'
    assert parameters("global-linear", Scoring(1, 1, gap=-1)) == '{"kind":"linear","substitution":{"type":"match-mismatch","match_score":1,"mismatch_penalty":1},"gap":-1}'
    assert parameters("global-affine", Scoring(2, 1, gap_open=-3, gap_extend=-1)) == '{"kind":"affine","substitution":{"type":"match-mismatch","match_score":2,"mismatch_penalty":1},"gap_open":-3,"gap_extend":-1}'
    assert parameters("local-linear", Scoring(gap=-4, matrix=m), "00ff") == '{"kind":"linear","substitution":{"type":"matrix","name":"m","source_sha256":"00ff"},"gap":-4}'
    assert parameters("global-linear", Scoring(), seeding=(15, 10, 128)).endswith('"gap":-2,"seed_k":15,"seed_window":10,"seed_flank":128}')
    assert Scoring(matrix=m).label() == "matrix:m" and Scoring(1, 1).label() == "match:1,mismatch:1"


def test_command(spark, tmp_path, capsys):
    (tmp_path / "q.fq").write_text("@q1\nACGT\n+\nIIII\n@q2\nAC-T\n+\nIIII\n")
    (tmp_path / "t.fa").write_text(">t1\nACCT\n>t2\nACT\n")
    files = ["--query-file", str(tmp_path / "q.fq"), "--target-file", str(tmp_path / "t.fa")]
    assert main(["edit-distance", *files, "--format", "tsv", "--verify"], spark) == 0
    said = capsys.readouterr().out.splitlines()
    assert said[0].startswith("pair_index\t") and [x.split("\t")[5] for x in said[1:]] == ["1", "1"] and "full" in said[2]
    assert main(["global-affine", *files, "--format", "sam", "--output", str(tmp_path / "sam"), "--engine", "auto", "--band", "1"], spark) == 0
    assert "".join(p.read_text() for p in sorted((tmp_path / "sam").glob("part-*"))).startswith("@HD")
    assert main(["global-linear", "--query", "WAR", "--target", "WR", "--matrix", "blosum62", "--gap", "-4", "--format", "json", "--certificate", "--show-alignment"], spark) == 0
    told = json.loads(capsys.readouterr().out)
    assert told["score"] == 11 - 4 + 5 and told["aligned_target"] == "W-R" and len(told["certificate"]["trace_sha256"]) == 64
    assert main(["seeded-global-linear", "--query", "TTACGTAA", "--target", "GGACGTCC", "--seed-k", "2", "--seed-window", "2", "--seed-flank", "1", "--format", "jsonl"], spark) == 0
    assert json.loads(capsys.readouterr().out)["cigar"] == "1X4=1X"
    bad = ["edit-distance", "--query", "AAAA", "--target", "TTTT", "--engine", "fixed-banded", "--band", "2", "--continue-on-error"]
    assert main(bad, spark) == 1 and "no alignment inside the band" in capsys.readouterr().out
    assert main(["edit-distance", "--query", "A", "--target", "A", "--engine", "x"], spark) == 2 and "engines" in capsys.readouterr().err
    assert main(["seeded-global-linear", "--query", "AAAA", "--target", "CCCC"], spark) == 2 and "seed" in capsys.readouterr().err
