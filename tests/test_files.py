"""Corpus files: round trips, rejects and missing paths."""

from ringwarden.sources.files import read_delimited, read_json_array, read_json_lines, read_optional, write_json_lines


def test_json_lines_skip_blank_lines_and_keep_nulls(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\n\n{"id": 2}\n')
    rows = read_json_lines(spark, str(tmp_path / "a.jsonl"), "id long, t string").collect()
    assert sorted((r["id"], r["t"]) for r in rows) == [(1, "x"), (2, None)]


def test_json_array_numbers_its_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"t": "b"},\n {"t": "a"}, {}]')
    rows = read_json_array(spark, str(tmp_path / "a.json"), "t string").collect()
    assert sorted((r["row"], r["t"]) for r in rows) == [(0, "b"), (1, "a"), (2, None)]


def test_delimited_lines_name_their_problem(spark, tmp_path):
    (tmp_path / "1.txt").write_text("0|a|one two three\n\n2|a|one two three\n1|b|one | two three\n1|c|one\n1|d\n")
    rows = read_delimited(spark, str(tmp_path / "*.txt"), ["0", "1"], 3).collect()
    assert sorted((r["file"], r["line"], r["label"], r["problem"]) for r in rows) == [
        ("1.txt", 1, "0", None), ("1.txt", 3, "2", "LABEL"), ("1.txt", 4, "1", "BAR"), ("1.txt", 5, "1", "SHORT"), ("1.txt", 6, "1", "FIELDS")]


def test_missing_source_is_empty(spark, tmp_path):
    assert read_optional(spark, str(tmp_path / "none.jsonl"), "id long").count() == 0


def test_written_rows_have_a_digest_of_the_set(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id long, t string")
    one = write_json_lines(a, str(tmp_path / "1")).first()
    other = write_json_lines(a.orderBy("id", ascending=False).coalesce(1), str(tmp_path / "2")).first()
    assert one == other and one["rows"] == 2
    assert write_json_lines(a.limit(0), str(tmp_path / "3")).first()["digest"] == 0
