"""Cleaning functions and sources against answers worked out by hand."""

from __future__ import annotations

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from placetrend import fixed_values as fv
from placetrend.functions import numeric, text
from placetrend.functions.geo import bessel_to_lv95, wgs84_to_lv95, wgs84_to_lv95_rigorous
from placetrend.operators import clean
from placetrend.sources import delimited, nodes, sheet, typed
from placetrend.sources.contract import require_columns, usable_tables
from placetrend.storage import scratch_path
from tests.helpers import frame, table


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("label", "dotted", "numeric_rule"),
    [
        ("......0001 Name", "Name", "......0001 Name"),
        ("261 Name", "261 Name", "Name"),
        ("- Region", "- Region", "- Region"),
        ("..12 .3 Twice", ".3 Twice", "..12 .3 Twice"),
    ],
)
def test_codes(spark, label, dotted, numeric_rule):
    assert one(spark, text.strip_dotted_code(F.lit(label))) == dotted
    assert one(spark, text.strip_numeric_code(F.lit(label))) == numeric_rule


def test_aggregate_rows(spark):
    df = frame(spark, "locality string", [("- Region",), (">> District",), ("Name",), ("Suisse",), (None,)])
    assert table(clean.drop_aggregate_rows(df)) == [("Name",), ("Suisse",)]
    assert table(clean.drop_aggregate_rows(df, national=fv.NATIONAL_LABEL)) == [("Name",)]


def test_sentinels(spark):
    df = frame(spark, "v string", [("X",), ("0",), ("12",), (None,)])
    got = [r[0] for r in df.select(text.sentinel_to_null(F.col("v"))).collect()]
    assert got == [None, None, 12, None]


def test_strict_and_lenient_casts(spark):
    with pytest.raises(PySparkException):
        frame(spark, "v string", [("junk",)]).select(text.sentinel_to_null(F.col("v"))).collect()
    with pytest.raises(PySparkException):
        frame(spark, "v string", [("Secteur quaternaire",)]).select(text.map_labels(F.col("v"))).collect()
    texts = {"abc": None, "NaN": None, "1.5": 1.5, None: None, "1.5d": None, "2F": None, " 2 ": 2.0, "1e3": 1000.0, "": None}
    df = frame(spark, "v string", [(t,) for t in texts])
    got = [r[0] for r in df.select(numeric.to_number(F.col("v"))).collect()]
    assert got == list(texts.values())


def test_year_from_name(spark):
    df = frame(spark, "v string", [("x-140101.osm",), ("x.osm",), ("a-1-22",)])
    assert [r[0] for r in df.select(text.year_from_name(F.col("v"))).collect()] == [2014, None, 2022]


def test_segments_use_present_ages_and_leave_out_96_and_over(spark):
    df = frame(
        spark,
        "`0 an` int, `1 an` int, `2 ans` int, `95 ans` int, `96 ans` int, `40 ans` int",
        [(1, 2, None, 5, 100, None)],
    )
    row = clean.segment_sums(df).first()
    assert [row[s] for s in fv.AGE_SEGMENTS] == [3, 0, 0, 5]


def test_year_range_allows_empty_exclusion(spark):
    df = frame(spark, "year int", [(2010,), (2011,), (2020,), (2025,), (2026,), (None,)])
    assert table(clean.year_range(df)) == [(2011,), (2020,), (2025,)]
    assert table(clean.year_range(df, exclude=[2020])) == [(2011,), (2025,)]


def test_unpivot_keeps_empty_cells(spark):
    df = frame(spark, "locality string, `2013` int, `2014` int", [("a", 1, None)])
    assert table(clean.unpivot_years(df, ["locality"], ["2013", "2014"])) == [("a", 2013, 1), ("a", 2014, None)]


def test_reprojection_check_value(spark):
    lat, lon = 46 + 2 / 60 + 38.87 / 3600, 8 + 43 / 60 + 49.79 / 3600
    east, north = wgs84_to_lv95(F.lit(lat), F.lit(lon))
    assert one(spark, F.round(east, 2)) == 2699999.76
    assert one(spark, F.round(north, 2)) == 1099999.97


def test_rates_guard_zero_divisors(spark):
    zero, four = F.lit(0), F.lit(4)
    assert one(spark, numeric.ratio(four, zero)) is None
    assert one(spark, numeric.growth_rate(four, zero)) is None
    assert one(spark, numeric.smoothed_growth_pct(zero, four)) == 400.0
    assert one(spark, numeric.cagr_pct(F.lit(2), F.lit(8), F.lit(2))) == pytest.approx(100.0)
    assert one(spark, numeric.cagr_pct(zero, four, F.lit(2))) is None
    assert one(spark, numeric.cagr_pct(four, four, zero)) is None
    assert one(spark, numeric.share_pct([F.lit(1), F.lit(2)], four)) == 75.0


def test_two_sided_p_matches_the_error_function(spark):
    from math import erfc, sqrt

    for z in (0.0, 0.3, -1.0, 1.96, 4.5, 7.0, 7.2, 9.0, 20.0):
        got = one(spark, numeric.two_sided_p(F.lit(z)))
        assert got == pytest.approx(erfc(abs(z) / sqrt(2)), rel=1e-9), z


def test_contracts(spark):
    good, bad = frame(spark, "locality string, trend_score double", []), frame(spark, "a int", [])
    assert require_columns(good, ["locality"]) is good
    with pytest.raises(ValueError, match="trend_score"):
        require_columns(bad, ["locality", "trend_score"])
    assert list(usable_tables({"g": good, "b": bad}, ["locality"])) == ["g"]
    assert clean.normalise_header(frame(spark, "` Locality ` string, YEAR int", [])).columns == ["locality", "year"]


# --- sheets -----------------------------------------------------------------------------------------


def grid(spark, rows):
    return frame(spark, "row_idx bigint, cells array<string>", rows)


def sheet_rows():
    pad = [None] * 4
    return [
        (1, ["Title"]),
        (3, [None] * 8 + ["Âge - total", "0 an", None]),
        (4, [None, None, None, "before any year", *pad, "9", "9"]),
        (5, ["2020", None, None, "- Suisse", *pad, "30", "3"]),
        (6, [None, None, None, "......0001 Aa", *pad, "10", "1"]),
        (7, ["12345", None, None, "......0002 Bb", *pad, "20"]),
        (8, ["2021", None, None, None]),
        (9, [None, None, None, "......0001 Aa", *pad, "11", "2"]),
        (10, [None, None, None, ""]),
    ]


@pytest.mark.parametrize("block_rows", [2, 1 << 16])
def test_tidy_sheet(spark, block_rows):
    tidy = sheet.tidy_sheet(grid(spark, sheet_rows()), block_rows=block_rows)
    assert table(tidy) == [
        (2020, "- Suisse", 30, 3),
        (2020, "......0001 Aa", 10, 1),
        (2020, "......0002 Bb", 20, None),
        (2021, "......0001 Aa", 11, 2),
    ]


@pytest.mark.parametrize("block_rows", [2, 3, 7, 1000])
def test_fill_down_equals_a_plain_scan(spark, block_rows):
    import random

    rng = random.Random(block_rows)
    rows, seen, expected, at = [], None, [], 0
    for _ in range(60):
        at += rng.choice([1, 1, 5, 40])
        value = rng.randrange(100) if rng.random() < 0.15 else None
        seen = value if value is not None else seen
        rows.append((at, value))
        expected.append((at, seen))
    df = frame(spark, "row_idx bigint, v int", rows)
    assert table(sheet.fill_down(df, "v", block_rows=block_rows)) == expected


def test_fill_down_without_any_value(spark):
    df = frame(spark, "row_idx bigint, v int", [(1, None)])
    assert table(sheet.fill_down(df, "v")) == [(1, None)]


def test_promote_year_header(spark):
    rows = [
        (2, ["x"]),
        (3, [None, None, None, "2013", "2014"]),
        (4, ["1", "......0001 Aa", fv.BUILDING_TYPE, "5", None]),
    ]
    wide = sheet.promote_year_header(grid(spark, rows))
    assert sheet.year_columns(wide) == ["2013", "2014"]
    assert table(wide) == [("1", "......0001 Aa", fv.BUILDING_TYPE, 5, None)]
    with pytest.raises(ValueError):
        sheet.promote_year_header(grid(spark, rows[:1]))


# --- files ------------------------------------------------------------------------------------------


def test_scan_errors_and_glob(spark, tmp_path):
    with pytest.raises(ValueError, match="no input file"):
        delimited.read_delimited(spark, str(tmp_path), delimited.COUNT_FILE_SCHEMA, glob="*.csv")
    (tmp_path / "a.csv").write_text("locality,year,num_restaurants\nAa,2020,3\n")
    (tmp_path / "b.csv").write_text("locality,year,num_restaurants\nBb,2021,4\n")
    (tmp_path / "c.txt").write_text("not,this,one\n")
    read = delimited.read_delimited(
        spark, str(tmp_path), delimited.COUNT_FILE_SCHEMA, glob="*.csv", source_column="file"
    )
    assert table(read) == [("Aa", 2020, 3, "a.csv"), ("Bb", 2021, 4, "b.csv")]


def test_scan_rejects_a_wrong_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("place,year,num_restaurants\nAa,2020,3\n")
    with pytest.raises(Exception, match="does not conform to the schema"):
        delimited.read_delimited(spark, str(tmp_path), delimited.COUNT_FILE_SCHEMA).collect()


def test_latin1_establishments(spark, tmp_path):
    content = "Année;Commune;Secteur économique;Etablissements;Emplois\n2020;261 Zürich;Secteur tertiaire;X;12\n"
    (tmp_path / "f.csv").write_bytes(content.encode("latin-1"))
    assert table(delimited.read_establishments(spark, str(tmp_path))) == [
        (2020, "261 Zürich", "Secteur tertiaire", "X", "12")
    ]


def test_csv_sink_creates_its_folder(spark):
    path = scratch_path(spark, "new/folder")
    delimited.write_delimited(frame(spark, "a int, b string", [(1, "x"), (2, None)]), path)
    assert table(spark.read.csv(path, header=True)) == [("1", "x"), ("2", None)]


NODE_XML = """<osm>
<node id="1" lat="46.5" lon="7.5"><tag k="amenity" v="restaurant"/><tag k="name" v="Krone"/></node>
<node id="2" lat="46.5" lon="7.5"><tag k="amenity" v="bank"/></node>
<node id="3" lat="46.5" lon="7.5"><tag k="shop" v="shoes"/></node>
<node id="4" lat="46.5" lon="7.5"/>
<node id="5" lat="95.0" lon="7.5"><tag k="amenity" v="restaurant"/></node>
<node id="6"><tag k="amenity" v="restaurant"/></node>
</osm>"""


def test_node_xml(spark, tmp_path):
    (tmp_path / "land-140101.osm").write_text(NODE_XML)
    (tmp_path / "land.osm").write_text(NODE_XML)
    got = nodes.amenity_nodes(nodes.read_node_xml(spark, str(tmp_path)))
    assert table(got) == [(1, 46.5, 7.5, "restaurant", "Krone", 2014), (2, 46.5, 7.5, "bank", None, 2014)]


def test_shared_folder_setting_wins(spark, monkeypatch):
    class Session:
        def __init__(self, **conf):
            self.values, self.conf = conf, self

        def get(self, key, default=None):
            return self.values.get(key.replace(".", "_"), default)

    from placetrend.storage import shared_folder

    assert shared_folder(Session(spark_checkpoint_dir="s3://shared/x/")) == "s3://shared/x"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session(spark_master="yarn"))


def test_snapshots_without_nodes_raise_and_those_without_a_year_are_logged(spark, caplog):
    schema = "id bigint, lat double, lon double, tags map<string,string>, snapshot string"
    rows = [(1, 46.0, 7.0, {"amenity": "restaurant"}, "x-140101.osm"), (2, 46.0, 7.0, {"amenity": "restaurant"}, "x.osm")]
    with pytest.raises(ValueError, match="no node"):
        nodes.checked_snapshots(frame(spark, schema, []))
    with caplog.at_level("WARNING"):
        kept = nodes.amenity_nodes(nodes.checked_snapshots(frame(spark, schema, rows)))
    assert [r.id for r in kept.collect()] == [1] and "1 of 2 nodes" in caplog.text


XML = """<?xml version="1.0"?>
<!-- <node id="99" lat="1" lon="1"/> -->
<osm>
  <node id="1" lat="46.5" lon="7.5"/>
  <node
     id="2"
     lat='46.6' lon="7.6">
    <tag k="amenity" v="restaurant"/>
    <tag v="A &amp; B &lt;&#233;&#x41;&gt; &quot;x&quot; &apos;y&apos; > z
 w" k="name"></tag>
  </node><node id="3" lat="46.7" lon="7.7"></node>
  <node id="x" lon="7.8"><tag k='amenity' v='bank'/></node>
  <way id="7"><nd ref="1"/><tag k="amenity" v="parking"/></way>
  <node id="4" lat="46.8" lon="7.8"><tag k="k" v=""/></node>
  <relation id="8"><member ref="7"/><tag k="name" v="r"/></relation>
</osm>
"""


def by_xml_reader(spark, path):
    """The nodes as the engine's own reader for XML gives them, one task a file."""
    schema = "_id STRING, _lat DOUBLE, _lon DOUBLE, tag ARRAY<STRUCT<_k: STRING, _v: STRING>>"
    raw = spark.read.format("xml").option("rowTag", "node").schema(schema).load(path)
    return raw.selectExpr("try_cast(_id AS BIGINT) AS id", "_lat AS lat", "_lon AS lon", "map_from_entries(tag) AS tags", "_metadata.file_name AS snapshot")


def node_rows(df):
    rows = df.selectExpr("id", "lat", "lon", "sort_array(map_entries(tags)) AS tags", "snapshot").collect()
    return sorted([(r.id, r.lat, r.lon, None if r.tags is None else [tuple(t) for t in r.tags], r.snapshot) for r in rows], key=repr)


def test_node_xml_equals_the_xml_reader(spark, tmp_path):
    (tmp_path / "land-140101.osm").write_text(XML)
    (tmp_path / "land-150101.osm").write_text(XML.replace("\n", " "))
    found = node_rows(nodes.read_node_xml(spark, str(tmp_path)))
    assert found == node_rows(by_xml_reader(spark, str(tmp_path))) and len(found) == 10
    assert (2, 46.6, 7.6, [("amenity", "restaurant"), ("name", "A & B <éA> \"x\" 'y' > z  w")], "land-140101.osm") in found


@pytest.mark.parametrize("size", [300, 1500])
def test_one_extract_is_read_by_many_tasks(spark, tmp_path, size):
    """Splits so small that nodes, tags and comments lie across two or more of them."""
    rng = random.Random(size)
    lines = []
    for k in range(200):
        tags = "".join(f'{rng.choice(["", chr(10)])}<tag k="k{j}" v="{"é" * rng.randrange(9)}&amp;{k}"/>' for j in range(rng.randrange(4)))
        lines.append(f'<node id="{k}" lat="46.{k}" lon="7.{k}"' + (f">{tags}</node>" if tags or k % 2 else "/>"))
        if k % 50 == 0:
            lines.append('<way id="1"><nd ref="3"/><tag k="name" v="w"/></way>')
    (tmp_path / "land-140101.osm").write_text("<osm>" + rng.choice(["", "\n"]).join(lines) + "</osm>")
    path = str(tmp_path / "land-140101.osm")
    want = node_rows(by_xml_reader(spark, path))
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    try:
        for key, value in zip(keys, (size, 0), strict=True):
            spark.conf.set(key, value)
        assert spark.read.option("lineSep", "<").text(path).rdd.getNumPartitions() > 10
        assert node_rows(nodes.read_node_xml(spark, path)) == want and len(want) == 200
    finally:
        for key in keys:
            spark.conf.unset(key)


def test_the_format_of_nodes_is_parquet_unless_named_otherwise(spark, tmp_path):
    frame(spark, "id int, snapshot string", [(1, "a")]).write.partitionBy("snapshot").parquet(str(tmp_path / "table"))
    (tmp_path / "osm" / "snapshot=land-14").mkdir(parents=True)
    (tmp_path / "osm" / "snapshot=land-14" / "x.osm").write_text(XML)
    assert nodes.node_format(spark, str(tmp_path / "table")) == "parquet"
    assert nodes.node_format(spark, str(tmp_path / "osm")) == "xml"
    assert nodes.node_format(spark, str(tmp_path / "osm" / "snapshot=land-14" / "x.osm")) == "xml"


def degrees(d, m, s):
    return d + m / 60 + s / 3600


def test_published_points_are_met_to_a_centimetre(spark):
    """The projection's centre, and a mountain whose place the survey publishes on the local ellipsoid."""
    for lat, lon, east, north in (
        (degrees(46, 57, 8.66), degrees(7, 26, 22.50), 2600000.00, 1200000.00),
        (degrees(47, 3, 28.95659233), degrees(8, 29, 11.11127154), 2679520.05, 1212273.44),
    ):
        e, n = bessel_to_lv95(F.radians(F.lit(lat)), F.radians(F.lit(lon)))
        assert (one(spark, e), one(spark, n)) == (pytest.approx(east, abs=0.01), pytest.approx(north, abs=0.01))
    # with the step of the datum; the example's angles are given to a hundredth of a second, a third of a metre
    e, n = wgs84_to_lv95_rigorous(F.lit(degrees(46, 2, 38.87)), F.lit(degrees(8, 43, 49.79)), F.lit(650.6))
    assert (one(spark, e), one(spark, n)) == (pytest.approx(2700000.0, abs=0.2), pytest.approx(1100000.0, abs=0.2))


def test_both_projections_agree_to_about_a_metre(spark):
    grid = spark.range(0, 60).selectExpr("45.9 + id % 10 * 0.18 AS lat", "6.1 + floor(id / 10) * 0.8 AS lon")
    a, b = wgs84_to_lv95(F.col("lat"), F.col("lon")), wgs84_to_lv95_rigorous(F.col("lat"), F.col("lon"))
    apart = grid.select(F.sqrt((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2).alias("d")).agg(F.max("d"), F.avg("d")).first()
    assert 0.05 < apart[0] < 1.5 and apart[1] < 0.7
    missing = wgs84_to_lv95_rigorous(F.lit(None).cast("double"), F.lit(7.4))
    assert one(spark, missing[0]) is None


MIXED = "whole,number,mixed,day,late,truth,blank,code,text\n" "1,1.5,1,2020-02-29,2020-01-01,true,,007,a\n" "-20,2,x,2021-12-31,2021-13-01,False,,12,\n" ",.5e3,2,,2022-01-01,TRUE,,1,b c\n"


def test_types_are_the_narrowest_that_take_every_cell(spark, tmp_path):
    (tmp_path / "m.csv").write_text(MIXED)
    df = typed.read_typed(spark, str(tmp_path / "m.csv"))
    assert dict(df.dtypes) == {
        "whole": "bigint", "number": "double", "mixed": "string", "day": "date", "late": "string", "truth": "boolean", "blank": "string", "code": "string", "text": "string",
    }
    assert [(r.whole, r.number, r.mixed, r.truth, r.blank, r.code, r.text) for r in df.collect()] == [
        (1, 1.5, "1", True, None, "007", "a"), (-20, 2.0, "x", False, None, "12", None), (None, 500.0, "2", True, None, "1", "b c"),
    ]


def test_a_row_behind_those_looked_at_that_breaks_the_type_raises(spark, tmp_path):
    (tmp_path / "t.csv").write_text("n,m\n" + "".join(f"{k},{k}\n" for k in range(50)) + "many,50\n")
    path = str(tmp_path / "t.csv")
    early = typed.read_typed(spark, path, first_rows=20)
    assert dict(early.dtypes) == {"n": "bigint", "m": "bigint"}
    with pytest.raises(PySparkException, match="column n is bigint, but a cell is many"):
        early.collect()
    assert early.agg(F.sum("m")).first()[0] == sum(range(51))
    assert dict(typed.read_typed(spark, path).dtypes) == {"n": "string", "m": "bigint"}
    assert dict(typed.read_typed(spark, path, declared={"n": "string", "m": "int"}).dtypes) == {"n": "string", "m": "int"}


def test_kinds_come_from_one_aggregate(spark, tmp_path):
    (tmp_path / "m.csv").write_text(MIXED)
    text = delimited.read_with_header(spark, str(tmp_path / "m.csv"))
    assert typed.column_kinds(text)["number"] == "double"
    assert typed.column_kinds(text.limit(0)) == dict.fromkeys(text.columns, "string")


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_strict_casts_do_not_rest_on_the_session(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        assert [one(spark, numeric.strict(F.lit(x), "bigint")) for x in ("12", " 7 ", "-3", None)] == [12, 7, -3, None]
        for column in (
            numeric.strict(F.lit("12.5"), "bigint"), numeric.strict(F.lit("300"), "tinyint"), text.sentinel_to_null(F.lit("x")), text.map_labels(F.lit("Secteur zero")),
        ):
            with pytest.raises(PySparkException, match="CAST_INVALID_INPUT"):
                one(spark, column)
        assert one(spark, text.sentinel_to_null(F.lit("X"))) is None
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
