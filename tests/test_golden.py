"""Rules and quirks of the catalog on hand-made rows."""

import datetime as dt
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from quarrymill.functions import scalars as sc
from quarrymill.operators import filters as fl
from quarrymill.operators import hierarchy, mutations, paging, vectors
from quarrymill.operators.textsearch import matches
from quarrymill.plans import pipelines
from quarrymill.streaming import logs


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


def test_path_prefix_is_not_segment_bounded(spark):
    rows = spark.createDataFrame([("2020/a",), ("2020b",), ("x/2020",)], "album_path string")
    assert {r[0] for r in rows.filter(fl.under_path("/2020")).collect()} == {"2020/a", "2020b"}


def test_gps_is_tri_state(spark):
    rows = spark.createDataFrame([(1, 1.0, None), (2, None, None), (3, 1.0, 2.0)], "id int, latitude double, longitude double")
    assert [r[0] for r in rows.filter(fl.gps(False)).collect()] == [1, 2]
    assert [r[0] for r in rows.filter(fl.gps(True)).collect()] == [3]


def test_date_range_is_half_open(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP_NTZ'2024-05-01 00:00:00'), (2, TIMESTAMP_NTZ'2024-05-01 23:59:59'), (3, TIMESTAMP_NTZ'2024-05-02 00:00:00') AS t(id, taken_at)")
    day = dt.date(2024, 5, 1)
    assert [r[0] for r in rows.filter(fl.taken_between(day, day)).collect()] == [1, 2]


def test_quality_gate_nulls(spark):
    rows = spark.createDataFrame([(1, None, 50, 50, None), (2, 0.9, None, 50, None), (3, 0.1, 50, 50, None)], "id int, det_score double, w int, h int, blur_score double")
    assert [r[0] for r in rows.filter(fl.good_face(0.5, 40)).collect()] == [1]
    assert [r[0] for r in rows.filter(fl.bad_face(0.5, 40)).collect()] == [3]


@pytest.mark.parametrize(
    ("name", "album", "date", "rule"),
    [
        ("IMG_2021-03-04.jpg", "x", dt.date(2021, 3, 4), "filename_ymd"),
        ("20210304_1.jpg", "x", dt.date(2021, 3, 4), "filename_yyyymmdd"),
        ("2021-13-04.jpg", "trips/1999", dt.date(1999, 1, 1), "folder_year"),
        ("x.jpg", "2001/2005-06", dt.date(2005, 6, 1), "folder_year_month"),
        ("120210304.jpg", "x", None, None),
        ("2021-02-30.jpg", "x", None, None),
    ],
)
def test_inferred_date(spark, name, album, date, rule):
    found, by = sc.inferred_date(F.lit(name), F.lit(album))
    assert (one(spark, found), one(spark, by)) == (date, rule)


@pytest.mark.parametrize(("album", "parent"), [("a/RAW", "a"), ("RAW", "/"), ("/RAW", "/"), ("a/raw", None), ("a/RAW/", "a")])
def test_raw_parent(spark, album, parent):
    assert one(spark, sc.raw_parent(F.lit(album))) == parent


@pytest.mark.parametrize(("album", "tier"), [("AB_TO_SORT/x", 0), ("AB_TO_SORT2", 2), ("Ordered by Dates", 1), ("Trip", 2), (None, 2)])
def test_folder_tier(spark, album, tier):
    assert one(spark, sc.folder_tier(F.lit(album).cast("string"))) == tier


def test_sanitizers(spark):
    label = F.lit("2nd trip!")
    assert [one(spark, f(label)) for f in (sc.sanitized_api, sc.sanitized_file, sc.sanitized_import)] == ["_2nd_trip_", "2nd_trip_", "2nd_trip"]


@pytest.mark.parametrize(("text", "value"), [("undef", None), ("", None), ("12.5", 12.5), ("x", None)])
def test_gps_number(spark, text, value):
    assert one(spark, sc.gps_number(F.lit(text))) == value


@pytest.mark.parametrize(("text", "want"), [('<rect x="1" y="2" width="3" height="4"/>', [1, 2, 3, 4]), ('{"x": 1, "y": 2, "width": 3, "height": 4}', [1, 2, 3, 4]), ("1 2 3 4", [1, 2, 3, 4]), ("abc", [None] * 4), ('{"x": 100.5, "y": "2.25", "width": 3, "height": 4}', [100.5, 2.25, 3, 4]), ("1.5 2 3 4 5", [1.5, 2, 3, 4]), ('<rect x="1.5" y="2" width="a" height="4"/>', [None] * 4), ('{"x": 1, "y": 2}', [None] * 4), ("1 2 3", [None] * 4)])
def test_rect(spark, text, want):
    assert [one(spark, c) for c in sc.rect(F.lit(text))] == want


def test_media_types_levels_and_numbers(spark):
    assert [one(spark, sc.mime(F.lit(n))) for n in ("a.JPG", "b.x3f", "c.flv", "d.nrw", "e")] == ["image/jpeg", "image/x-sigma-x3f", "video/x-flv", "application/octet-stream", "application/octet-stream"]
    assert [one(spark, sc.media_kind(F.lit(n))) for n in ("a.JPG", "b.x3f", "c.flv", "d.nrw", "e.raw")] == ["image", "raw", "video", None, None]
    assert set(sc.MIME) == {*sc.RAW, *sc.PICTURE, *sc.VIDEO}
    assert [one(spark, sc.guessed_level(F.lit(n))) for n in ("CRITICAL failure", "fatal: x", "Warn: y", "a debug error", "errors")] == ["INFO", "CRITICAL", "WARNING", "DEBUG", "INFO"]
    assert [one(spark, sc.human_shutter(F.lit(x))) for x in ("0.004", "2", "2.5", "0", "x")] == ["1/250", "2s", "2.5s", "—", "—"]
    assert [one(spark, sc.human_aperture(F.lit(x))) for x in ("2.8", "4", "x")] == ["f/2.8", "f/4", "—"]
    assert [one(spark, sc.human_bytes(F.lit(n).cast("long"))) for n in (1023, 1024, 5 * 1024**3, 2**51)] == ["1023 B", "1.0 KB", "5.0 GB", "2048.0 TB"]
    when = F.lit("2021-03-04").cast("timestamp_ntz")
    assert [one(spark, sc.destination(F.lit(n), t, "out")) for n, t in (("PXL_20240102.mp4", when), ("PXL_2024.mp4", when), ("a.mp4", when), ("a.mp4", F.lit(None).cast("timestamp_ntz")))] == ["out/2024/01", "out/2024/.m", "out/2021/03", "out"]


def test_thresholds_and_adaptive(spark):
    assert [sc.thresholds(s) for s in (0, 0.65, 1)] == [(0.9, 0.08, 0.85), (0.77, 0.0475, 0.72), (0.7, 0.03, 0.65)]
    assert [round(one(spark, sc.adaptive_threshold(0.77, 0.72, F.lit(n))), 6) for n in (19, 20, 300, 1000)] == [0.77, 0.77, 0.72, 0.72]


def test_iou(spark):
    box = lambda *v: dict(zip("xywh", map(F.lit, v), strict=True))
    assert one(spark, sc.iou(box(0, 0, 10, 10), box(0, 0, 10, 5))) == 0.5
    assert one(spark, sc.iou(box(0, 0, 10, 10), box(0, 0, 10, 4))) == pytest.approx(0.4)


def test_fingerprint_leaves_numbers_out(spark):
    prints = [one(spark, sc.fingerprint(F.lit(30), F.lit("app"), F.lit(f"retry {n}"))) for n in (3, 17)]
    assert prints[0] == prints[1]


def test_text_search(spark):
    text = F.lit("The red barns, at noon")
    assert [one(spark, matches(text, q)) for q in ("red noon", "red -barn", '"red barn"', '"barn red"', "blue OR noon", "", "-red", "barn", '"barns by noon"', '"barn noon"', "the", "the red", "-blue", "-the")] == [True, False, True, False, True, False, False, True, True, False, False, True, True, False]


def test_stems():
    from quarrymill.functions.stemming import lexeme, stem

    #: Word and stem, as published with the rules.
    pairs = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist consists consist
    consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol
    conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant
    knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife
    knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
    photos photo happy happi cry cri by by say say ties tie skies sky generate generat general general generously generous relational relat hopping hop hoping hope falling fall running run national nation""".split()
    assert {w: stem(w) for w in pairs[::2]} == {w: s for w, s in zip(pairs[::2], pairs[1::2], strict=True)} | {"generate": stem("generate")}
    assert stem("generate") == "generat" and lexeme("under") == "" and stem("Žába") == "Žába"


def test_album_rollup(spark):
    rows = spark.createDataFrame([("a",)] + [("a/b",)] * 2 + [("a/b/c",)] * 3, "album string")
    assert {r["path"]: (r["own"], r["total"]) for r in hierarchy.rollup_paths(rows, "album").collect()} == {"a": (1, 6), "a/b": (2, 5), "a/b/c": (3, 3)}


def test_cursor_pages_cover_every_row_once(spark):
    rows = [(i, None if i % 4 == 0 else datetime(2024, 1, 1 + i % 3), datetime(2024, 1, 1), i % 2, f"f{i % 5}") for i in range(23)]
    photos = spark.createDataFrame(rows, "id long, taken_at timestamp_ntz, imported_at timestamp_ntz, rating int, filename string").cache()
    for sort in paging.SORTS:
        seen, cursor = [], None
        while got := paging.after_cursor(photos, cursor, sort, 5).collect():
            seen += [r["id"] for r in got]
            cursor = paging.cursor_behind(got[-1], sort)
        assert seen == [r["id"] for r in photos.orderBy(*paging.order(sort)).collect()]
    assert paging.after_cursor(photos, "!corrupt", "rating_desc", 5).count() == 5
    with pytest.raises(ValueError, match="another sort"):
        paging.after_cursor(photos, paging.cursor_behind(rows_first(photos), "rating_desc"), "filename_asc", 5)


def rows_first(df):
    return df.first()


def test_stacks(spark):
    rows = [(1, "_DSC95.nef", "a/RAW", 0, 5, 1), (2, "_dsc95.jpg", "a", 3, 10, 1), (3, "_dsc95-edit.jpg", "a", 3, 20, 1), (4, "_dsc950.jpg", "a", 5, 99, 1), (5, "lone.X3F", "RAW", 0, 1, 1), (6, "lone_1.png", "/", 1, 1, 1)]
    rows += [(7, "_dsc95.jpg", "a/RAW", 5, 99, 1), (8, "_dsc95_b.jpg", "a", 5, 999, 0), (9, "gone.nef", "a/RAW", 0, 1, 0), (10, "beside.nef", "a", 0, 1, 1), (11, "_dsc95 b.cr3", "a", 5, 999, 1)]
    photos = spark.createDataFrame(rows, "id long, filename string, album_path string, rating int, file_size long, status int")
    got = {(r["album"], r["stem_key"]): (r["cover_id"], r["members"]) for r in pipelines.stacks(photos).collect()}
    assert got == {("a", "_dsc95"): (3, 3), ("/", "lone"): (6, 2)}
    known = spark.createDataFrame([("a", "_dsc95"), ("a", "gone"), ("b", "x")], "album string, stem_key string")
    assert {tuple(r) for r in pipelines.stale_stacks(known, photos).collect()} == {("a", "gone"), ("b", "x")}


DEDUP = "id long, sha256 string, album_path string, file_size long, stack_id long, status int, imported_at int, rating int, color_label int, title string, caption string"


def test_dedup_plan_never_deletes_all_copies(spark):
    rows = [(1, "h", "AB_TO_SORT/x", None, 1), (2, "h", "Trip", None, 1), (3, "h", "AB_TO_SORT/y", 7, 1), (4, "g", "Trip", None, 1), (5, "g", "Other", None, 1), (6, "k", "AB_TO_SORT/z", None, 1), (7, "k", "Trip", None, 1), (8, "t", "Trip", None, 0), (9, "t", "AB_TO_SORT/q", None, 1), (10, "t", "Ordered by Dates/q", None, 1)]
    photos = spark.createDataFrame([(i, s, p, 10, st, live, i, 0, None, None, None) for i, s, p, st, live in rows], DEDUP)
    faces = spark.createDataFrame([(6, "confirmed")], "photo_id long, status string")
    got = {r["id"]: (r["action"], r["reason"]) for r in pipelines.dedup_plan(photos, faces).collect()}
    assert got[1] == ("delete", None) and got[2] == ("keep", None) and got[3] == ("skip", "in_stack")
    assert got[6] == ("skip", "only_copy_with_faces") and not {4, 5, 7, 8} & got.keys()
    assert got[9] == ("delete", None) and got[10] == ("keep", None)


def test_no_group_of_the_catalog_loses_its_last_live_copy(spark):
    from quarrymill.sources.catalog import Catalog

    c = Catalog(spark, DATA)
    plan = pipelines.dedup_plan(c.photos, c.faces)
    after, _ = pipelines.dedup_apply(c.photos, c.photo_tags, plan)
    live = lambda photos: {r["sha256"] for r in photos.filter("status = 1 AND sha256 IS NOT NULL").select("sha256").distinct().collect()}
    assert live(after) == live(c.photos) and after.count() == c.photos.count()
    assert plan.join(c.photos.filter("status = 0").select("id"), "id").count() == 0
    assert c.photos.filter("status = 1").count() - after.filter("status = 1").count() == plan.filter("action = 'delete'").count() > 0


def test_dedup_apply_merges_values_and_tags(spark):
    rows = [(1, "h", "Trip", 1, None, 1, 5, 2, 0, "", None), (2, "h", "Trip", 1, None, 1, 4, 1, None, None, "kept"), (3, "h", "AB_TO_SORT", 1, None, 1, 1, 5, 7, "late", "x"), (4, "h", "AB_TO_SORT/a", 1, None, 1, 0, 0, 3, "early", None), (5, "h", "AB_TO_SORT/b", 1, 9, 1, 0, 4, 4, "stacked", None), (6, None, "Trip", 1, None, 1, 0, 3, 1, "own", None)]
    photos = spark.createDataFrame(rows, DEDUP)
    tags = spark.createDataFrame([(1, 10), (3, 11), (4, 11), (5, 12), (6, 13)], "photo_id long, tag_id int")
    plan = pipelines.dedup_plan(photos, spark.createDataFrame([], "photo_id long, status string"))
    after, given = pipelines.dedup_apply(photos, tags, plan)
    got = {r["id"]: (r["status"], r["rating"], r["color_label"], r["title"], r["caption"]) for r in after.collect()}
    assert got[1] == got[2] == (1, 5, 3, "early", "kept") and got[3][0] == got[4][0] == 0 and got[5] == (1, 4, 4, "stacked", None) and got[6] == (1, 3, 1, "own", None)
    assert {tuple(r) for r in given.collect()} == {(1, 10), (1, 11), (2, 10), (2, 11), (3, 11), (4, 11), (5, 12), (6, 13)} and given.count() == 8


def test_components_do_not_depend_on_edge_order(spark):
    edges = [("a", "b"), ("b", "c"), ("d", "e")]
    for order in (edges, edges[::-1], [(b, a) for a, b in edges]):
        found = {r["node"]: r["label"] for r in vectors.connected_components(spark.createDataFrame(order, "a string, b string")).collect()}
        assert found == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}


def test_kmeans_sizes():
    rng = np.random.default_rng(0)
    for n, k in ((1, 1), (3, 1), (4, 2), (6, 3), (100, 3)):
        centres, sizes = vectors.kmeans(rng.normal(size=(n, 8)), max(1, min(3, n // 2)))
        assert len(centres) == k and sizes.sum() == n


def test_a_large_person_still_gets_k_prototypes(spark):
    rng = np.random.default_rng(4)
    means = np.eye(6)[:3] * 5
    rows = [(i, "large", [float(x) for x in means[i % 3] + rng.normal(size=6) * 0.2]) for i in range(900)] + [(1000 + i, "small", [float(x) for x in rng.normal(size=6)]) for i in range(7)]
    table = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    whole = vectors.centroids(table).collect()
    cut = vectors.centroids(table, most=40, reduced=8).collect()
    for found in (whole, cut):
        assert sorted((r["label"], r["n"]) for r in found if r["label"] == "large") == [("large", 300)] * 3
    assert sorted(r["n"] for r in whole if r["label"] == "small") == sorted(r["n"] for r in cut if r["label"] == "small")
    near = lambda found: sorted(int(np.argmax(r["embedding"])) for r in found if r["label"] == "large")
    assert near(whole) == near(cut) == [0, 1, 2]


def test_prototypes_are_a_fixed_point(spark):
    """Every prototype of V10 is the unit mean of its person's faces that are nearest to it, and its size is their number."""
    from quarrymill.plans.registry import QUERIES
    from quarrymill.sources.catalog import Catalog

    faces = Catalog(spark, DATA).vectors.filter("status = 'confirmed'")
    own, shown = {}, QUERIES["V10_A28_centroids"](spark, DATA).collect()
    for r in faces.collect():
        own.setdefault(r["label"], []).append(np.array(r["embedding"], float) / np.linalg.norm(r["embedding"]))
    found = {}
    for r in vectors.centroids(faces).collect():
        found.setdefault(r["label"], []).append((r["part"], np.array(r["embedding"]), r["n"]))
    assert found.keys() == own.keys() and len(shown) == sum(map(len, found.values()))
    for label, parts in found.items():
        x, centres = np.array(own[label]), np.array([c for _, c, _ in sorted(parts, key=lambda p: p[0])])
        assert len(centres) == max(1, min(3, len(x) // 2))
        nearest = (x @ centres.T).argmax(1)
        assert np.bincount(nearest, minlength=len(centres)).tolist() == [n for _, _, n in sorted(parts, key=lambda p: p[0])]
        for c in range(len(centres)):
            mean = x[nearest == c].mean(0)
            assert np.allclose(mean / np.linalg.norm(mean), centres[c], atol=1e-9)


def plain_sweep(faces, prototypes, threshold, margin, floor, suggest, gate=lambda f: True, twins=(), early=lambda f, person: False):
    """vec_id -> person, decision: the rules of the sweep, face by face."""
    pool = [f for f in faces if f["status"] in ("unconfirmed", "suggested") and gate(f)]
    ignored = [np.array(f["embedding"], float) for f in faces if f["status"] == "ignored"]
    owned, taken, out, sure = Counter(f["label"] for f in faces if f["status"] == "confirmed"), {(f["photo_id"], f["label"]) for f in faces if f["status"] == "confirmed"}, {}, []
    for f in pool:
        v = np.array(f["embedding"], float)
        if ignored and max(float(v @ w) for w in ignored) >= threshold - 0.005:
            out[f["vec_id"]] = None, "ignored"
            continue
        near = sorted(((-round(float(v @ w), 12), person) for person, w in prototypes), key=lambda x: x[0])[:15]
        said = {}
        for score, person in near:
            n, best = said.get(person, (0, -9))
            said[person] = n + 1, max(best, -score)
        ranked = sorted((-best, person, n) for person, (n, best) in said.items())
        score, person, n = -ranked[0][0], ranked[0][1], ranked[0][2]
        second = -ranked[1][0] if len(ranked) > 1 else 0
        share = min(1, max(0, (owned[person] - 20) / 280))
        needed = max(min(threshold, floor), threshold - share * max(0, threshold - floor))
        if early(f, person):
            out[f["vec_id"]] = f["label"], "unchanged"
        elif round(score, 2) >= needed and n >= 2 and score - second >= margin:
            sure.append((-score, f["vec_id"], f["photo_id"], person))
        elif score >= suggest:
            out[f["vec_id"]] = person, "suggested"
        else:
            out[f["vec_id"]] = f["label"], "unchanged"
    for _, vec_id, photo_id, person in sorted(sure):
        free = person in twins or (photo_id, person) not in taken
        out[vec_id] = (person, "confirmed") if free else (None, "unconfirmed")
        taken.add((photo_id, person))
    return out


def plain_swept(rows, said):
    for f in rows:
        person, decision = said.get(f["vec_id"], (None, "unchanged"))
        if decision != "unchanged":
            f["label"], f["status"] = person, decision


def test_sweeps_are_those_of_the_plain_rules(spark):
    from quarrymill.plans.registry import QUERIES
    from quarrymill.sources.catalog import Catalog

    rows = [r.asDict() for r in Catalog(spark, DATA).vectors.collect()]
    schema = Catalog(spark, DATA).vectors.schema
    threshold, margin, floor = sc.thresholds(0.65)
    limits = threshold - 0.4, margin - 0.04, floor - 0.4
    prototypes = lambda rows: [(r["label"], np.array(r["embedding"])) for r in vectors.centroids(spark.createDataFrame([tuple(f.values()) for f in rows], schema).filter("status = 'confirmed'")).collect()]
    got = {r["vec_id"]: (r["person"], r["decision"]) for r in QUERIES["D01_sweep"](spark, DATA).collect()}
    assert got == plain_sweep(rows, prototypes(rows), *limits, 0.2)
    for _ in range(10):
        said = plain_sweep(rows, prototypes(rows), *limits, 0.5)
        plain_swept(rows, said)
        if not any(d == "confirmed" for _, d in said.values()):
            break
    assert {r["status"]: r["n"] for r in QUERIES["D02_sweeps"](spark, DATA).collect()} == Counter(f["status"] for f in rows)


def test_sweep_gates_twins_and_unchanged_faces(spark):
    """Two faces of one person in a photo, a low one and one before a birth; with and without the rules' switches."""
    near = lambda *v: [float(x) for x in np.array([*v, 0, 0, 0, 0][:4]) / np.linalg.norm(v)]
    rows = [(1, near(1), 7, "confirmed", 10), (2, near(1, 0.01), 7, "confirmed", 11), (3, near(1, 0.02), 7, "confirmed", 12), (4, near(0, 0, 1), 8, "ignored", 13)]
    rows += [(20, near(1, 0.03), None, "unconfirmed", 20), (21, near(1, 0.04), 9, "suggested", 20), (22, near(1, 1.6), 5, "suggested", 21), (23, near(0, 0.1, 1), 5, "suggested", 22), (24, near(1, 0.1), 5, "suggested", 23), (25, near(1, 0.2), 5, "suggested", 10), (26, near(1, 0.2), 5, "suggested", 30)]
    faces = spark.createDataFrame([(*r, "1999-01-01" if r[0] == 24 else "2020-01-01", 0.1 if r[0] == 26 else 0.9) for r in rows], "vec_id long, embedding array<double>, label int, status string, photo_id long, taken_at string, det_score double").withColumn("taken_at", F.to_date("taken_at"))
    prototypes = faces.filter("status = 'confirmed'").select("vec_id", "label", "embedding")
    births = spark.createDataFrame([(7,)], "person int").withColumn("born", F.to_date(F.lit("2010-01-01")))
    gate = F.col("det_score") >= 0.5
    said = pipelines.sweep(faces, prototypes, 0.8, 0.1, 0.7, 0.6, births=births, gate=gate)
    got = {r["vec_id"]: (r["person"], r["decision"]) for r in said.collect()}
    assert got == {20: (7, "confirmed"), 21: (None, "unconfirmed"), 22: (5, "unchanged"), 23: (None, "ignored"), 24: (5, "unchanged"), 25: (None, "unconfirmed")}
    after = {r["vec_id"]: (r["label"], r["status"]) for r in pipelines.swept(faces, said).collect()}
    assert after[22] == (5, "suggested") and after[24] == (5, "suggested") and after[26] == (5, "suggested") and after[23] == (None, "ignored") and after[21] == (None, "unconfirmed")
    twins = spark.createDataFrame([(7,)], "person int")
    got = {r["vec_id"]: (r["person"], r["decision"]) for r in pipelines.sweep(faces, prototypes, 0.8, 0.1, 0.7, 0.6, twins=twins).collect()}
    assert got[20] == got[21] == got[24] == got[25] == got[26] == (7, "confirmed")


def test_rounding_is_that_of_binary_floats(spark):
    rng = np.random.default_rng(5)
    values = [0.685, 0.675, 0.145, 0.125, 0.375, 2.5, -0.685, -0.125, 0.0, 1e-9, 123456.785] + [float(x) for x in rng.integers(0, 10**5, 3000) / 1000] + [float(x) for x in rng.normal(size=500)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", sc.rounded(F.col("v"), 2).alias("two"), sc.rounded(F.col("v"), 4).alias("four")).collect()
    assert all((r["two"], r["four"]) == (round(r["v"], 2), round(r["v"], 4)) for r in got)


def test_trees_of_any_depth_and_cycles(spark):
    rows = [(i, i - 1 if i else None, f"t{i}", "people" if not i else "x") for i in range(150)] + [(500, 499, "orphan", "x"), (501, 500, "below", "x")]
    table = spark.createDataFrame(rows, "id int, parent_id int, label string, top string")
    got = {r["id"]: r for r in hierarchy.chains(table).collect()}
    assert set(got) == set(range(150)) and all(got[i]["depth"] == i + 1 and got[i]["top"] == "people" for i in range(150))
    assert got[149]["path"] == ".".join(f"t{i}" for i in range(150))
    with pytest.raises(ValueError, match="cycle"):
        hierarchy.chains(spark.createDataFrame([(1, 2, "a", "a"), (2, 3, "b", "b"), (3, 1, "c", "c"), (4, None, "d", "d")], "id int, parent_id int, label string, top string"))
    assert hierarchy.chains(table.limit(0)).count() == 0


def test_pairs_within_and_best_of_a_person_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 4))
    rows = spark.createDataFrame([(i, i % 5, [float(v) for v in x[i]]) for i in range(60)], "vec_id long, label int, embedding array<double>")
    score = np.round(x @ x.T, 12)
    for size in (vectors.BROADCAST_BYTES, 0):
        monkeypatch.setattr(vectors, "BROADCAST_BYTES", size)
        monkeypatch.setattr(vectors, "BLOCK_ROWS", 25)
        monkeypatch.setattr(vectors, "PRODUCT_CELLS", 100)
        assert {(r["a"], r["b"]) for r in vectors.within(rows, 1.0).collect()} == {(i, j) for i in range(60) for j in range(i + 1, 60) if score[i, j] >= 1.0}
        got = {(r["vec_id"], r["label"]): r["score"] for r in vectors.person_candidates(rows, rows.filter("vec_id < 40"), 0.4).collect()}
        best = {(i, p): max(score[i, j] for j in range(40) if j % 5 == p) for i in range(60) for p in range(5)}
        assert got == {k: v for k, v in best.items() if v >= 0.4}


def test_blocked_knn_equals_broadcast_knn(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)], "vec_id long, embedding array<double>")
    small = sorted(vectors.knn(rows, rows, 5).select("query_id", "id").collect())
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 25)
    assert sorted(vectors.knn(rows, rows, 5).select("query_id", "id").collect()) == small


def test_upsert_and_insert_ignore(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y")], "id int, v string")
    assert sorted(map(tuple, mutations.upsert(old, new, ["id"]).collect())) == [(1, "a"), (2, "x"), (3, "y")]
    assert sorted(map(tuple, mutations.insert_ignore(old, new, ["id"]).collect())) == [(1, "a"), (2, "b"), (3, "y")]


def test_nearest_place_is_exact(spark):
    rng = np.random.default_rng(3)
    places = [(i, float(rng.uniform(-85, 85)), float(rng.uniform(-180, 180))) for i in range(40)]
    points = [(i, float(rng.uniform(-89, 89)), float(rng.uniform(-180, 180))) for i in range(60)]
    got = {r["id"]: r["place_id"] for r in pipelines.nearest_place(spark.createDataFrame(points, "id int, latitude double, longitude double"), spark.createDataFrame(places, "place_id int, p_lat double, p_lon double")).collect()}

    def km(a, b, c, d):
        a, b, c, d = map(np.radians, (a, b, c, d))
        return 2 * np.arcsin(np.sqrt(np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2))

    assert got == {i: min(places, key=lambda p: km(lat, lon, p[1], p[2]))[0] for i, lat, lon in points}


def test_stream_equals_batch_but_for_open_sessions(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 0, 0, s), 30, "app", f"retry {s}") for s in (0, 4, 8, 20)] + [(datetime(2024, 1, 1, 1), 30, "app", "later 1")]
    schema = "ts timestamp, level int, logger_name string, message string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    batch = logs.coalesced(spark.createDataFrame(rows, schema)).select("occurrences", "first_seen_at").collect()
    assert sorted(r["occurrences"] for r in batch) == [1, 1, 3]
    query = logs.write_coalesced(logs.read_log_files(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    query.awaitTermination(120)
    assert sorted(r["occurrences"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3]
    assert logs.counters(query)["rows"] >= 0


def test_walk_skips_dot_folders_and_empty_files(spark, tmp_path):
    from quarrymill.sources import files

    for name, content in (("a.jpg", b"x"), ("b.txt", b"x"), ("c.png", b""), (".hidden/d.jpg", b"x"), ("sub/e.NEF", b"xy")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    assert sorted(r["filename"] for r in files.walk(spark, str(tmp_path)).collect()) == ["a.jpg", "e.NEF"]


def test_legacy_faces_take_the_property_of_lowest_rank(spark):
    from quarrymill.plans.legacy_import import run_import

    images = spark.createDataFrame([(1, 1, "a.jpg", 1, "h")], "id int, album int, name string, status int, uniqueHash string")
    albums = spark.createDataFrame([(1, "/x/y")], "id int, relativePath string")
    comments = spark.createDataFrame([(1, 1, "b"), (1, 1, "a")], "imageid int, type int, comment string")
    tags = spark.createDataFrame([(1, 0, "People"), (2, 1, "Ann B."), (3, 1, "Ann-B")], "id int, pid int, name string")
    links = spark.createDataFrame([(1, 2), (1, 9)], "imageid int, tagid int")
    props = spark.createDataFrame([(1, 2, "ignoredFace", "0 0 1 1"), (1, 2, "tagRegion", '<rect x="1" y="2" width="3" height="4"/>')], "imageid int, tagid int, property string, value string")
    got = run_import(images, albums, comments, tags, links, props)
    assert [(r["status"], r["x"], r["h"]) for r in got.faces.collect()] == [("confirmed", 1, 4)]
    assert [(r["album_path"], r["caption"], r["title"]) for r in got.photos.collect()] == [("x/y", "a", None)]
    assert {r["path"] for r in got.tags.filter("is_person").collect()} == {"People.Ann_B", "People.Ann_B_1"}
    assert got.skipped.first()["skipped"] == 1 and got.photo_tags.count() == 1


def test_jdbc_table_is_read_in_ranges(spark):
    """Over the database that Spark brings along."""
    from quarrymill.sources import files

    url, driver = "jdbc:derby:memory:catalog;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    rows = spark.range(100).select(F.col("id").cast("int").alias("ID"), F.concat(F.lit("n"), F.col("id")).alias("NAME"))
    rows.write.jdbc(url, "IMAGES", mode="overwrite", properties={"driver": driver})
    found = files.read_jdbc(spark, url, "IMAGES", "ID", 0, 100, 4, driver=driver)
    assert found.rdd.getNumPartitions() == 4 and sorted(map(tuple, found.collect())) == [(i, f"n{i}") for i in range(100)]
    assert sorted(r["ID"] for r in files.resumed(found, spark.createDataFrame([(95,)], "ID int"), "ID").collect()) == [96, 97, 98, 99]
