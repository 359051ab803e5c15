"""Guards fail the job and name the offenders; lines are counted over the splits of a file."""

import json

import pytest

from entitysurv.operators import guards as G
from entitysurv.operators import rows as R
from entitysurv.sources import io


def test_incomplete_modes_are_named(spark):
    cell = lambda c, m, *modes: [(c, m, o) for o in modes]
    make = lambda *cells: spark.createDataFrame(sum(cells, []), "condition string, asr_model string, asr_mode string")
    whole = make(cell("a", "m0", "t", "v"), cell("b", None, "t", "v"))
    assert G.require_modes(whole).count() == 4
    some = make(cell("a", "m0", "t", "v"), *(cell(c, None, "v") for c in "edcb"))
    with pytest.raises(Exception, match="incomplete modes: b/- has only v, c/- has only v, d/- has only v") as e:
        G.require_modes(some).count()
    assert "e/-" not in str(e.value).split("SQLSTATE")[0].split("\n")[0]


def test_missing_utterances_are_named(spark):
    rows = spark.createDataFrame([("u1",), ("u1",), ("u7",), (None,)], "utterance_id string")
    assert G.require_utterances(rows.where("utterance_id = 'u1'"), rows).collect() == [("u1",), ("u1",)]
    with pytest.raises(Exception, match="utterances without a corpus row: null, u7"):
        G.require_utterances(rows, rows.where("utterance_id = 'u1'")).collect()
    assert [r[0] for r in R.missing_utterances(rows, rows.where("utterance_id = 'u1'")).orderBy("utterance_id").collect()] == [None, "u7"]
    assert G.require_utterances(rows.limit(0), rows).count() == 0


def test_conditions_declared_twice_or_not_at_all(spark):
    dim = spark.createDataFrame([("clean",), ("noisy",)], "name string")
    rows = spark.createDataFrame([("clean",), ("burst",)], "condition string")
    assert G.unique_conditions(dim).count() == 2 and G.require_conditions(rows.where("condition = 'clean'"), dim).count() == 1
    with pytest.raises(Exception, match="unknown conditions: burst; known: clean, noisy"):
        G.require_conditions(rows, dim).collect()
    with pytest.raises(Exception, match="duplicate condition names: noisy"):
        G.unique_conditions(dim.unionAll(dim.where("name = 'noisy'"))).collect()


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def write(path, lines):
    path.write_text("".join(f"{x}\n" for x in lines), encoding="utf-8")


def utterance(i):
    return json.dumps({"id": f"u{i}", "language": "en-IN", "text": "é" * (i % 40), "entities": []})


def test_lines_are_numbered_over_splits(spark, tmp_path, small_splits):
    lines = {"b.jsonl": [utterance(i) if i % 3 else "// no" if i % 2 else "" for i in range(400)], "a.jsonl": ["", utterance(900)], "c.jsonl": []}
    for name, ls in lines.items():
        write(tmp_path / name, ls)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
    got = sorted((r.file.rsplit("/", 1)[-1], r.line, r.value) for r in io.numbered_lines(spark, str(tmp_path)).collect())
    assert got == sorted((name, i, x) for name, ls in lines.items() for i, x in enumerate(ls, 1))
    first = io.scan_corpus(spark, str(tmp_path), limit=101, position=True).orderBy("file", "line").collect()
    assert [r.id for r in first] == ["u900", *(f"u{i}" for i in range(400) if i % 3)][:101] and first[1].line == 2
    assert io.scan_corpus(spark, str(tmp_path)).count() == 1 + sum(i % 3 > 0 for i in range(400)) and io.scan_corpus(spark, str(tmp_path), limit=0).count() == 0


def test_a_bad_line_is_named_with_its_number(spark, tmp_path, small_splits):
    for bad in ("not json", '{"id":"x","entities":[{"type":"otp","surface":" ","normalized":"1"}]}'):
        write(tmp_path / "c.jsonl", [*(utterance(i) for i in range(300)), bad, utterance(301)])
        for df in (io.scan_corpus(spark, str(tmp_path / "c.jsonl")), io.scan_corpus(spark, str(tmp_path / "c.jsonl"), limit=3)):
            with pytest.raises(Exception, match=r"bad utterance in \S*c\.jsonl:301: "):
                df.collect()
