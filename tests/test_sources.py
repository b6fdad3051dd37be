"""Readers and writers of lists, records and pipe-delimited lines."""

from starloom.sources.tables import read_ids, read_list, read_records, write_pipe


def write(path, text):
    path.write_text(text)
    return str(path)


def test_a_list_with_comments(spark, tmp_path):
    path = write(tmp_path / "list.csv", "# made by hand\nid,mag\n1,9.5\n# 2,3\n3,\n")
    assert [tuple(r) for r in read_list(spark, path).orderBy("id").collect()] == [("1", "9.5"), ("3", None)]


def test_ids_with_and_without_prefix(spark, tmp_path):
    path = write(tmp_path / "ids.txt", "# targets\n12\nTIC 345\ntic7 # seven\n\nnone\n 9,1\n")
    assert sorted(r.tic for r in read_ids(spark, path).collect()) == [7, 9, 12, 345]


def test_broken_records_stand_apart(spark, tmp_path):
    folder = tmp_path / "records"
    folder.mkdir()
    write(folder / "a.json", '{"tic": 1,\n "depth": 0.5}')
    write(folder / "b.json", '{"tic": 2, "depth"')
    write(folder / "c.json", '{"tic": 3}')
    good, broken = read_records(spark, str(folder), "tic long, depth double")
    assert sorted((r.tic, r.depth) for r in good.collect()) == [(1, 0.5), (3, None)]
    assert [r.file for r in broken.collect()] == ["b.json"]


def test_pipe_lines_hold_one_cell_a_column(spark, tmp_path):
    d = spark.createDataFrame([(1, "a|b \n c"), (2, None)], "tic long, note string")
    write_pipe(d.coalesce(1), ["tic", "note"], str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1|a/b c", "2|"]
