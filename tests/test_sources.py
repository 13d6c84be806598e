"""The sweep as a source, and files per entity with commits."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from tallyfield.sources import entity_files, sweeps
from tallyfield.sources.paged import TransportError
from tallyfield.streaming import limits


def review(k, minutes):
    return {"recommendationid": str(k), "author": {"playtime_at_review": minutes}}


class Service:
    """Pages of a title; counts the requests."""

    def __init__(self, pages):
        self.pages, self.asked = pages, []

    def __call__(self, appid, filter_, cursor):
        self.asked.append((filter_, cursor))
        k = 0 if cursor == "*" else int(cursor)
        return self.pages[filter_][k]


def swept(service, cache, **more):
    return [(r[1], r[2], r[3], r[6]) for r in sweeps.sweep_title(service, cache, "7", list(service.pages), 9, **more)]


FOUR = [0, 500, 3000, 7000]


def test_sweep_stops_and_goes_on_from_its_cache(tmp_path):
    pages = {"recent": [{"reviews": [review(10 * p + k, m) for k, m in enumerate(FOUR)], "cursor": str(p + 1)} for p in range(6)]}
    pages["helpful"] = [{"reviews": [review(k, m) for k, m in enumerate(FOUR)], "cursor": "0"}, {"reviews": [], "cursor": "x"}]
    pages["helpful"][0]["cursor"] = "1"
    service, cache = Service(pages), sweeps.PageCache(str(tmp_path / "a"))
    # two pages are enough, but three are the least; the other filter shows nothing new and is ended by its empty page
    assert swept(service, cache, min_pages=3, quota=2) == [("recent", 0, "*", False), ("recent", 1, "1", False), ("recent", 2, "2", False), ("helpful", 0, "*", False), ("helpful", 1, "1", False)]
    asked = len(service.asked)
    for mode in ("live", "replay", "strict"):
        assert [r[3] for r in swept(service, cache, min_pages=3, quota=2, mode=mode)] == [True] * 5
    assert len(service.asked) == asked
    # a higher quota goes on from the last cached cursor
    assert [r[3] for r in swept(service, cache, min_pages=3, quota=4) if r[0] == "recent"] == [True, True, True, False]
    assert service.asked[asked:] == [("recent", "3")]
    assert [r[1] for r in swept(service, cache, quota=9, mode="replay") if r[0] == "recent"] == [0, 1, 2, 3]
    with pytest.raises(sweeps.LiveCall):
        swept(service, cache, quota=9, mode="strict")
    # a page that another cursor led to, and a torn file, are fetched again
    path = tmp_path / "a" / "7" / "recent" / "000001.json"
    path.write_text(json.dumps(json.loads(path.read_text()) | {"cursor": "other"}))
    (tmp_path / "a" / "7" / "recent" / "000002.json").write_text("{")
    assert [r[3] for r in swept(service, cache, min_pages=3, quota=2) if r[0] == "recent"] == [True, False, False]


def test_sweep_ends_at_a_cursor_that_stands_still(tmp_path):
    stuck = Service({"recent": [{"reviews": [review(1, 5)], "cursor": "*"}]})
    assert len(swept(stuck, sweeps.PageCache(str(tmp_path)))) == 1

    def refused(appid, filter_, cursor):
        raise TransportError(403)

    with pytest.raises(TransportError):
        list(sweeps.sweep_title(refused, sweeps.PageCache(str(tmp_path / "b")), "7", ["recent"], 3))


def test_sweep_as_a_stream(spark, tmp_path):
    pieces = [(f"{a}-{f}-{p}.json", 0, 0, json.dumps({"cursor": str(p + 1) if p < 4 else None, "reviews": [review(100 * a + 10 * p + k, m) for k, m in enumerate(FOUR)]})) for a in (1, 2) for f in ("x", "y") for p in range(5)]
    entity_files.write_entities(spark.createDataFrame(pieces, entity_files.PIECES), str(tmp_path / "served"))
    transport = f"tallyfield.sources.sweeps:served?{tmp_path}/served/{entity_files.current_version(str(tmp_path / 'served'))[0]}"
    ask = {"max_pages": 5, "cache": str(tmp_path / "cache"), "transport": transport}
    for k in range(4):
        stream = sweeps.stream_sweep(spark, ["1", "2"], ["x", "y"], pages=3, **ask)
        got = limits.run_to_end(stream, "append", str(tmp_path / "run"))
        assert got.count() == 2 * min(10, 3 * (k + 1))
    assert got.select("appid", "filter", "page").distinct().count() == 20
    whole = sweeps.read_sweep(spark, ["1", "2"], ["x", "y"], mode="strict", **ask)
    assert whole.where(~F.col("cached")).count() == 0 and sorted(whole.select("appid", "filter", "page", "payload").collect()) == sorted(got.select("appid", "filter", "page", "payload").collect())


def test_titles_of_a_sweep_share_partitions():
    titles = [str(k) for k in range(1000)]
    for reader in (sweeps._Reader({"appids": ",".join(titles), "slices": "7"}), sweeps._Reader({"appids": ",".join(titles)})):
        dealt = [p.value[0] for p in reader.partitions()]
        assert len(dealt) <= sweeps.SLICES and sorted(sum(dealt, [])) == sorted(titles)
    assert sweeps._Reader({"appids": ""}).partitions() == [] and len(sweeps._Reader({"appids": "1,2"}).partitions()) == 2


# --- files


def files_of(spark, path):
    return {r.name: r.content for r in entity_files.read_entities(spark, path).collect()}


def test_files_are_swapped_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "out")
    assert files_of(spark, path) == {}
    rows = [(f"f{k % 7}.txt", k % 2, k, f"{k};") for k in range(100)]
    entity_files.write_entities(spark.createDataFrame(rows, entity_files.PIECES).repartition(5), path)
    want = {f"f{n}.txt": "".join(f"{k};" for _, k in sorted((k % 2, k) for k in range(100) if k % 7 == n)) for n in range(7)}
    assert files_of(spark, path) == want
    first = entity_files.current_version(path)[0]
    for bad in ([("../x", 0, 0, "a")], [("_x", 0, 0, "a")], [(None, 0, 0, "a")], [("ok.txt", 0, 0, "a"), ("", 0, 0, "b")]):
        with pytest.raises(Exception, match="can't be the name"):
            entity_files.write_entities(spark.createDataFrame(bad, entity_files.PIECES), path)
        assert files_of(spark, path) == want and entity_files.current_version(path)[0] == first  # nothing of it is seen
    assert not list((tmp_path / "out" / "_staged").glob("*"))
    entity_files.write_entities(spark.createDataFrame([("new.txt", 0, 0, None), ("new.txt", 0, 1, "é\n")], entity_files.PIECES), path)
    assert files_of(spark, path) == {"new.txt": "é\n"} and entity_files.current_version(path)[1] == first
    entity_files.write_entities(spark.createDataFrame([], entity_files.PIECES), path)
    assert files_of(spark, path) == {} and not (tmp_path / "out" / first).exists()


def test_an_attempt_that_is_overtaken_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    writer = entity_files._Writer(path)
    rows = [Row("a.txt", 0, 0, "one"), Row("b.txt", 0, 0, "two")]

    def dies():
        yield rows[0]
        raise RuntimeError

    with pytest.raises(RuntimeError):
        writer.write(dies())
    overtaken, done = writer.write(iter(rows)), writer.write(iter(rows))
    assert overtaken.folder != done.folder
    writer.commit([done, None])
    assert files_of(spark, path) == {"a.txt": "one", "b.txt": "two"}
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"_current.json", "_staged", writer.job}
    other = entity_files._Writer(path)
    with pytest.raises(ValueError, match="two tasks"):
        other.commit([other.write(iter(rows)), other.write(iter(rows))])
    assert files_of(spark, path) == {"a.txt": "one", "b.txt": "two"}
    with pytest.raises(ValueError, match="follow one another"):
        other.write(iter([rows[0], rows[1], Row("a.txt", 0, 1, "x")]))
    with pytest.raises(ValueError, match="in order"):
        other.write(iter([Row("a.txt", 1, 0, "x"), Row("a.txt", 0, 9, "x")]))


def test_documents_and_reports(spark, tmp_path):
    docs = spark.createDataFrame([(7, "x", None), (8, None, [1])], "appid int, word string, list array<int>")
    entity_files.write_entities(entity_files.json_pieces(docs, "appid"), str(tmp_path / "json"))
    assert {k: json.loads(v) for k, v in files_of(spark, str(tmp_path / "json")).items()} == {"7.json": {"appid": 7, "word": "x", "list": None}, "8.json": {"appid": 8, "word": None, "list": [1]}}
    rows = [("g", 3, "early", "b", "t3"), ("g", 1, None, "a", None), ("g", 2, "mid", "b", "t2"), ("g", 4, "mid", None, "kept"), (None, 5, "mid", "a", "t5")]
    pieces = entity_files.dropped_pieces(spark.createDataFrame(rows, "game string, rid int, bucket string, reason string, text string"), ["a", "b"])
    entity_files.write_entities(pieces, str(tmp_path / "txt"))
    assert files_of(spark, str(tmp_path / "txt"))["g.dropped.txt"] == "# dropped reviews - g\n# 3 reviews, by reason\n\n## a (1)\n\n[1] unknown\n\n\n## b (2)\n\n[2] mid\nt2\n[3] early\nt3\n"
