"""The jobs from files to files, chained as a user would chain them."""

from __future__ import annotations

import gzip
from pathlib import Path

import pytest

from placetrend import fixed_values as fv
from placetrend import storage
from placetrend.plans.restaurants import restaurant_counts
from placetrend.run import main
from placetrend.sources import delimited, nodes, scores
from placetrend.sources.scores import read_score_folder
from tests.helpers import frame, table

NODE = '<node id="{i}" lat="{lat}" lon="7.4"><tag k="amenity" v="restaurant"/><tag k="name" v="N"/></node>'


def read(spark, path):
    return spark.read.csv(str(path), header=True, inferSchema=True)


def test_all_jobs_to_the_final_ranking(spark, tmp_path: Path):
    def at(name):
        return str(tmp_path / name)

    grid = "row_idx bigint, cells array<string>"
    pad = [None] * 4
    people = [(3, [None] * 8 + ["Âge - total", "10 ans", "25 ans", "40 ans", "60 ans"])]
    for y in range(2019, 2025):
        start = (y - 2000) * 10
        people.append((start, [str(y), None, None, "- Total", *pad, "99"]))
        for i, name in enumerate(("Aa", "Bb"), 1):
            grown = str(10 + (y - 2019) * i)
            people.append((start + i, [None, None, None, f"......000{i} {name}", *pad, "100", grown, grown, "5", "5"]))
    frame(spark, grid, people).write.parquet(at("people"))
    built = [(3, [None] * 3 + [str(y) for y in range(2013, 2024)])]
    for i, name in enumerate(("Aa", "Bb"), 1):
        built.append((3 + i, ["c", f"......000{i} {name}", fv.BUILDING_TYPE, *[str(k * k * i) for k in range(11)]]))
    frame(spark, grid, built).write.parquet(at("built"))
    (tmp_path / "osm").mkdir()
    for k, y in enumerate(range(14, 18)):
        body = "".join(NODE.format(i=i, lat=46.9 if i % 3 else 46.0) for i in range((k + 1) * 5))
        (tmp_path / "osm" / f"land-{y}0101.osm").write_text(f"<osm>\n{body}\n</osm>")
    box = [{"x": x, "y": y} for x, y in ((2.5e6, 1.15e6), (2.8e6, 1.15e6), (2.8e6, 1.3e6), (2.5e6, 1.3e6))]
    frame(spark, "NAME string, ring array<struct<x:double,y:double>>", [("Aa", box)]).write.parquet(at("layer"))
    lines = ["Année;Commune;Secteur économique;Etablissements;Emplois"]
    lines += [f"{y};{i} {n};Secteur tertiaire;{10 + i * y % 7};{100 + i * (y - 2015) ** 2}" for y in range(2015, 2024) for i, n in ((1, "Aa"), (2, "Bb"))]
    (tmp_path / "est.csv").write_bytes("\n".join(lines).encode("latin-1"))

    main(["demography", "--sheet", at("people"), "--out", at("demo")])
    main(["demography", "--sheet", at("people"), "--detail", "--out", at("demo_detail")])
    main(["building", "--sheet", at("built"), "--out", at("building")])
    main(["restaurant-counts", "--nodes", at("osm"), "--polygons", at("layer"), "--out", at("counts")])
    main(["restaurant-trend", "--counts", at("counts"), "--out", at("trend")])
    main(["restaurant-trend", "--counts", at("counts"), "--scores-only", "--out", at("restau")])
    for m in ("jobs", "establishments"):
        main(["third-sector", "--file", at("est.csv"), "--measure", m, "--out", at(m)])
    paths = dict(zip(fv.COMPOSITE_SCORES, ("jobs", "building", "demo", "restau", "establishments")))
    scores = [f"{n}={at(p)}" for n, p in paths.items()]
    main(["normalise", "--scores", *scores, "--out", at("normalised")])
    main(["final", "--scores", *scores, "--out", at("final")])

    assert read(spark, tmp_path / "demo").columns == ["locality", "trend_score"]
    assert len(read(spark, tmp_path / "demo_detail").columns) == 10
    assert [r[2] for r in sorted(read(spark, tmp_path / "counts").collect(), key=lambda r: r.year)] == [3, 6, 10, 13]
    assert read(spark, tmp_path / "trend").first().locality == "Aa"
    assert {r.indicator for r in read(spark, tmp_path / "normalised").collect()} == set(fv.COMPOSITE_SCORES)
    final = read(spark, tmp_path / "final")
    assert final.columns == ["commune", *fv.COMPOSITE_SCORES, "total"]
    assert {r.commune for r in final.collect()} == {"Aa", "Bb"}
    for row in final.collect():
        assert row.total == pytest.approx(sum(row[c] for c in fv.COMPOSITE_SCORES))
    assert table(final, "restau_score") == [(0.0,), (10.0,)]


def scores_at(path: Path, name: str, body: str) -> None:
    (path / name).write_text(body)


@pytest.fixture
def mixed_folder(tmp_path: Path) -> Path:
    """A good file, one with more columns, one without the columns, one that cannot be read, an empty one,
    one that breaks off, a folder of files, and results of an earlier run."""
    folder = tmp_path / "res +ults"
    folder.mkdir()
    scores_at(folder, "good.csv", "locality,trend_score\nAa,4\nBb,-2\nCc,n.a.\n")
    scores_at(folder, "plain.csv", "locality,trend_score\nAa,1\n")
    scores_at(folder, "wide.csv", "rank,trend_score,locality\n1,3,Aa\n")
    scores_at(folder, "other.csv", "commune,total\nAa,4\n")
    scores_at(folder, "empty.csv", "")
    scores_at(folder, "broken.csv.gz", "no archive")
    whole = gzip.compress(("locality,trend_score\n" + "".join(f"L{k},{k * 7919 % 1000}\n" for k in range(20_000))).encode())
    (folder / "cut.csv.gz").write_bytes(whole[: len(whole) // 2])
    scores_at(folder, "good_norma.csv", "locality,trend_score\nAa,99\n")
    scores_at(folder, "notes.txt", "locality,trend_score\nAa,98\n")
    (folder / "parts").mkdir()
    scores_at(folder / "parts", "part-0.csv", "locality,trend_score\nAa,5\n")
    scores_at(folder / "parts", "part-1.csv", "locality,trend_score\nDd,10\n")
    (folder / "earlier" / "indicator=good").mkdir(parents=True)
    scores_at(folder / "earlier" / "indicator=good", "part-0.csv", "locality,trend_score\nAa,97\n")
    return folder


def test_a_folder_of_scores_loses_only_its_bad_files(spark, mixed_folder):
    said: list[str] = []
    found = read_score_folder(spark, str(mixed_folder), report=said.append)
    assert found.names == ["good", "parts", "plain", "wide"]
    assert table(found.stacked) == [
        ("good", "Aa", 4.0), ("good", "Bb", -2.0), ("good", "Cc", None), ("parts", "Aa", 5.0), ("parts", "Dd", 10.0), ("plain", "Aa", 1.0), ("wide", "Aa", 3.0),
    ]
    assert set(found.left_out) == {"other", "empty", "broken", "cut"} and len(said) == 4
    assert "lacks" in found.left_out["other"] and "empty" in found.left_out["empty"]


def test_scores_named_one_by_one_tolerate_a_bad_path(spark, mixed_folder, tmp_path):
    paths = {"a": str(mixed_folder / "good.csv"), "b": str(mixed_folder / "missing.csv"), "c": str(mixed_folder / "parts")}
    main(["normalise", "--scores", *(f"{n}={p}" for n, p in paths.items()), "--out", str(tmp_path / "out")])
    assert {r.indicator for r in read(spark, tmp_path / "out").collect()} == {"a", "c"}


def test_a_folder_without_scores_gives_a_message(spark, tmp_path):
    said: list[str] = []
    (tmp_path / "none").mkdir()
    found = read_score_folder(spark, str(tmp_path / "none"), report=said.append)
    assert found.names == [] and found.stacked.count() == 0 and said == ["no score table was found"]
    main(["normalise", "--folder", str(tmp_path / "none"), "--out", str(tmp_path / "out")])
    assert not (tmp_path / "out").exists()
    with pytest.raises(ValueError, match="no folder"):
        read_score_folder(spark, str(tmp_path / "nowhere"))


def test_scaling_a_folder_into_itself_never_reads_its_own_result(spark, mixed_folder):
    for _ in range(2):
        main(["normalise", "--folder", str(mixed_folder), "--out", str(mixed_folder / "scaled")])
        scaled = read(spark, mixed_folder / "scaled")
        assert table(scaled.where("locality = 'Aa'"), "indicator", "trend_score") == [("good", 10.0), ("parts", 5.0), ("plain", 10.0), ("wide", 10.0)]
    scores_at(mixed_folder, "plain.csv", "locality,trend_score\nZz,-3\n")
    (mixed_folder / "wide.csv").unlink()
    main(["normalise", "--folder", str(mixed_folder), "--out", str(mixed_folder / "scaled")])
    again = table(read(spark, mixed_folder / "scaled"), "indicator", "locality", "trend_score")
    assert ("plain", "Zz", -10.0) in again and ("plain", "Aa", 10.0) not in again
    assert ("wide", "Aa", 10.0) in again  # a partition of an earlier run that this one has no rows for


def test_tables_of_one_header_are_one_scan(spark, mixed_folder):
    scans = []
    original = scores._scan
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(scores, "_scan", lambda s, group: scans.append(sorted(group)) or original(s, group))
        (mixed_folder / "cut.csv.gz").unlink()
        read_score_folder(spark, str(mixed_folder))
    assert sorted(scans) == [["good", "parts", "plain"], ["wide"]]


def test_a_second_run_replaces_and_a_failed_one_leaves_the_result(spark, tmp_path):
    out = str(tmp_path / "out")
    delimited.write_delimited(frame(spark, "a int", [(1,), (2,)]), out)
    delimited.write_delimited(frame(spark, "a int", [(3,)]), out)
    assert table(read(spark, out)) == [(3,)]
    delimited.write_delimited(read(spark, out).selectExpr("a + 1 AS a"), out)  # reads what it replaces
    assert table(read(spark, out)) == [(4,)]
    bad = frame(spark, "a int", [(1,), (0,)]).selectExpr("10 / a AS a")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        delimited.write_delimited(bad, out)

    def refuse():
        raise ValueError("not this one")

    with pytest.raises(ValueError, match="not this one"):
        delimited.write_delimited(frame(spark, "a int", [(9,)]), out, check=refuse)
    assert table(read(spark, out)) == [(4,)]
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    (tmp_path / "file").write_text("old")
    delimited.write_delimited(frame(spark, "a int", [(5,)]), str(tmp_path / "file"))
    assert table(read(spark, tmp_path / "file")) == [(5,)]


def test_partitions_of_a_failed_run_stay(spark, tmp_path):
    out = str(tmp_path / "out")
    delimited.write_by_partition(frame(spark, "k string, a int", [("x", 1), ("y", 2)]), out, "k")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        delimited.write_by_partition(frame(spark, "k string, a int", [("x", 0)]).selectExpr("k", "1 / a AS a"), out, "k")
    delimited.write_by_partition(frame(spark, "k string, a int", [("y", 3)]), out, "k")
    assert table(read(spark, out), "k", "a") == [("x", 1), ("y", 3)]


def test_a_job_deletes_its_tables_between_stages(spark, tmp_path):
    with storage.scratch_of_a_job(spark):
        path = storage.scratch_path(spark, "trial")
        spark.range(3).write.parquet(path)
        assert spark.read.parquet(path).count() == 3
    system, place = storage.file_system(spark, path)
    assert not system.exists(place)


def test_no_node_leaves_the_earlier_counts(spark, tmp_path, caplog):
    box = [{"x": x, "y": y} for x, y in ((2.5e6, 1.15e6), (2.8e6, 1.15e6), (2.8e6, 1.3e6), (2.5e6, 1.3e6))]
    frame(spark, "NAME string, ring array<struct<x:double,y:double>>", [("Aa", box)]).write.parquet(str(tmp_path / "layer"))
    schema = "id bigint, lat double, lon double, tags map<string,string>, snapshot string"
    rows = [(1, 46.9, 7.4, {"amenity": "restaurant", "name": "N"}, "land-140101"), (2, 46.9, 7.4, {"amenity": "restaurant", "name": "N"}, "land")]
    frame(spark, schema, rows).write.parquet(str(tmp_path / "nodes"))
    frame(spark, schema, []).write.parquet(str(tmp_path / "no_nodes"))
    given = ["--polygons", str(tmp_path / "layer"), "--snapshot-column", "snapshot", "--out", str(tmp_path / "out")]
    main(["restaurant-counts", "--nodes", str(tmp_path / "nodes"), *given])
    assert "1 of 2 nodes" in caplog.text
    assert table(read(spark, tmp_path / "out")) == [("Aa", 2014, 1)]
    with pytest.raises(ValueError, match="no node was loaded"):
        main(["restaurant-counts", "--nodes", str(tmp_path / "no_nodes"), *given])
    assert table(read(spark, tmp_path / "out")) == [("Aa", 2014, 1)]


def test_the_nodes_are_scanned_once(spark, tmp_path):
    schema = "id bigint, lat double, lon double, tags map<string,string>, snapshot string"
    rows = [(k, 46.9, 7.4, {"amenity": "restaurant", "name": "N"}, "land-140101") for k in range(50)]
    frame(spark, schema, rows).write.parquet(str(tmp_path / "nodes"))
    read_rows = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read_rows.add(batch.num_rows)
            yield batch

    loaded = nodes.read_node_table(spark, str(tmp_path / "nodes"), "snapshot")
    watched, check = nodes.watched_snapshots(loaded.mapInArrow(seen, loaded.schema))
    box = frame(spark, "name string, ring array<struct<x:double,y:double>>", [("Aa", [(2.5e6, 1.15e6), (2.8e6, 1.15e6), (2.8e6, 1.3e6), (2.5e6, 1.3e6)])])
    delimited.write_delimited(restaurant_counts(nodes.amenity_nodes(watched), box), str(tmp_path / "out"), check=check)
    assert read_rows.value == 50 and table(read(spark, tmp_path / "out")) == [("Aa", 2014, 50)]


def test_series_without_a_fit_are_reported(spark, tmp_path, caplog):
    rows = [("bad", 2011, 0), ("bad", 2012, 0), ("bad", 2013, 5), ("ok", 2011, 3), ("ok", 2012, 4), ("ok", 2013, 7)]
    frame(spark, "locality string, year int, num_restaurants int", rows).write.csv(str(tmp_path / "counts"), header=True)
    main(["restaurant-trend", "--counts", str(tmp_path / "counts"), "--out", str(tmp_path / "out")])
    assert "1 of 2 series have no fit" in caplog.text and "bad" in caplog.text
