"""Workbooks, identities, reviews, pages and whole runs."""

import pytest
from pyspark.sql import functions as F

from sijill.functions import names
from sijill.operators import evidence as ev
from sijill.operators import identity, ranking, tokens, verifier
from sijill.plans import ranking_run
from sijill.sinks import exports
from sijill.sources import listings, workbooks


def book(tmp_path, name, rows):
    path = tmp_path / name
    path.write_bytes(exports.workbook({"ورقة": rows}))
    return str(path)


@pytest.fixture(scope="module")
def master(spark, tmp_path_factory):
    tmp_path = tmp_path_factory.mktemp("books")
    rows = [
        ("الاسم", "التواريخ", "الرتبة", "الصفحة", "الملاحظات"),
        ("بندر عمارة الساحلي", "1443/08/11 | 1443/07/12", "عريف", 2, ""),
        ("طارق وليد الرملي", "1443/08/03", "", 3, "إجازة 1443/05/05"),
        ("محمد ولد الجبيلي", "1443/08/12", "", 1, ""),
        ("محمد وليد الجبيلي", "1443/08/13, 05/06/1443", "", 1, ""),
        ("", "1443/01/01", "", 1, ""),
        ("بندر عمارة الساحلي", "1443/08/11; 1443/06/01", "رقيب", "x", ""),
    ]
    return ranking_run.load_master(spark, [book(tmp_path, "m.xlsx", rows), "notes.doc"], ranking_run.RunContext())


def test_workbook_master(master):
    people = {r.original_name: r for r in master.people.collect()}
    assert set(people) == {"بندر عمارة الساحلي", "طارق وليد الرملي", "محمد ولد الجبيلي", "محمد وليد الجبيلي"}
    assert people["بندر عمارة الساحلي"].rank_title == "عريف" and people["بندر عمارة الساحلي"].pages == [2]
    assert people["محمد ولد الجبيلي"].identity_needs_review and people["محمد ولد الجبيلي"].aliases == ["محمد وليد الجبيلي"]
    dates = {r.person_key: r.dates for r in ev.histories(master.evidence).collect()}
    assert dates[people["بندر عمارة الساحلي"].person_key] == [14430811, 14430712, 14430601]
    assert dates[people["طارق وليد الرملي"].person_key] == [14430803, 14430505]


def test_targets_and_run(spark, master):
    typed = listings.typed(spark, ["بندر عمارة الساحلي", "طارق وليد الرملي", "بندر عماره الساحلي", "شخص غير موجود بالمرة", "ab", "طارق وليد الرملي"])
    found = identity.targets(typed, master.people)
    status = {r.original_name: (r.status, r.matched_master_name) for r in found.collect()}
    assert status["بندر عمارة الساحلي"] == (identity.VERIFIED, "بندر عمارة الساحلي")
    assert status["بندر عماره الساحلي"] == (identity.NEEDS_REVIEW, "بندر عمارة الساحلي")
    assert status["شخص غير موجود بالمرة"][0] == identity.NOT_IN_MASTER and len(status) == 4
    results, summary = ranking_run.run(found, master)
    rows = {r.original_name: (r.rank, r.status) for r in results.collect()}
    assert rows["طارق وليد الرملي"] == (1, ranking.RANKED) and rows["شخص غير موجود بالمرة"] == (None, identity.NOT_IN_MASTER)
    one = summary.first()
    assert (one.total, one.ranked_candidates, one.not_found, one.skipped_needs_review) == (2, 2, 1, 1)
    listed, _ = ranking_run.run_list(found, master)
    assert {r.id: r.rank for r in listed.collect()}["n0"] == 2


def test_pending_dates_block(spark, master):
    typed = listings.typed(spark, ["طارق وليد الرملي"])
    own = master.evidence.withColumn("verified", F.col("date") != 14430505)
    results, summary = ranking_run.run(identity.targets(typed, master.people), ranking_run.Master(master.people, own))
    assert [(r.rank, r.status) for r in results.collect()] == [(None, ranking.NEEDS_REVIEW)] and summary.first().blocked_by_pending_dates == 1
    again = own.unionByName(own.where("date = 14430505").withColumn("verified", F.lit(True)))
    results, _ = ranking_run.run(identity.targets(typed, master.people), ranking_run.Master(master.people, again))
    assert [r.rank for r in results.collect()] == [1]


def test_corrections(spark, master):
    found = identity.targets(listings.typed(spark, ["بندر عماره الساحلي", "شخص غير موجود بالمرة", "طارق وليد الرملي"]), master.people)
    said = [(1, "n0", "confirm", None), (1, "n1", "choose_candidate", "لا أحد هنا أبدا"), (1, "n2", "reject", None), (2, "n2", "set_name", "طارق وليد الرملي"), (9, "zz", "confirm", None)]
    after = {r.id: r for r in identity.corrected(found, spark.createDataFrame(said, "seq long, id string, action string, name string"), master.people).collect()}
    assert after["n0"].status == identity.VERIFIED and after["n0"].user_corrected_name == "بندر عمارة الساحلي"
    assert after["n1"].status == identity.NOT_IN_MASTER and after["n2"].status == identity.VERIFIED
    assert {r.id: r.action for r in identity.auto_commands(found).collect()} == {"n2": "confirm"}


def test_date_reviews(spark, master):
    said = [(1, "طارق وليد الرملي", "delete_date", "1443-08-03", 0), (2, "طارق وليد الرملي", "add_date", "1442/01/02", 4), (3, "طارق وليد الرملي", "add_date", "05/06/1443", 4), (4, "لا أحد", "verify_all", None, 0)]
    after = ev.reviewed(master.evidence, master.people, spark.createDataFrame(said, "seq long, name string, action string, date string, page long"))
    key = names.key(F.lit("طارق وليد الرملي"))
    assert sorted(r.date for r in after.where(F.col("person_key") == key).collect()) == [14420102, 14430505]


def test_rename_merges(spark, master):
    people, evidence = ev.rename(master.people, master.evidence, "محمد ولد الجبيلي", "محمد وليد الجبيلي")
    assert people.count() == 3 and evidence.where(F.col("person_key") == "محمد وليد الجبيلي").count() == 2


def test_compare_people(master):
    row = ranking_run.compare_people(master, "طارق وليد الرملي", "بندر عمارة الساحلي").first()
    assert (row.result, row.level, row.date_a) == ("a", 0, "1443/08/03")
    assert ranking_run.compare_people(master, "طارق وليد الرملي", "غير موجود").count() == 0


def token(text, x, y, source="a", confidence=0.95, page=1, w=0.12, h=0.02):
    return (page, text, x, y, w, h, confidence, source)


READING = "page long, text string, x double, y double, w double, h double, confidence double, source string"


def test_votes(spark):
    rows = spark.createDataFrame([token("١٤٤٧/٨/١٥", 0.1, 0.5, "a", 0.98), token("١٤٤٧/٨/١٥", 0.1, 0.5, "b", 0.96), token("١٤٤٧/٨/١٦", 0.1, 0.5, "c", 0.91)], READING)
    [one] = tokens.voted(rows).collect()
    assert (one.text, one.agreement, [a.text for a in one.alternatives]) == ("١٤٤٧/٨/١٥", 2, ["١٤٤٧/٨/١٦"])


def test_page_without_grid(spark):
    rows = spark.createDataFrame([token("1443/08/15 و 1443/07/20", 0.10, 0.5, s) for s in "ab"] + [token("عريف", 0.55, 0.5, s, w=0.05) for s in "ab"] + [token("محمد فرحان الرملي", 0.75, 0.5, s) for s in "ab"], READING)
    made = ranking_run.master_from_readings(rows)
    [person] = made.people.collect()
    assert (person.original_name, person.rank_title) == ("محمد فرحان الرملي", "عريف")
    assert sorted(r.date for r in made.evidence.collect()) == [14430720, 14430815] and not any(r.verified for r in made.evidence.collect())


def test_page_with_grid(spark):
    rows = spark.createDataFrame([token("1443/08/15", 0.10, 0.48, s) for s in "ab"] + [token("محمد فرحان الرملي", 0.78, 0.48, s) for s in "ab"] + [token("فهد سالم الرويلي", 0.78, 0.38, s) for s in "ab"], READING)
    rules = spark.createDataFrame([(1, x) for x in (0.044, 0.717, 0.770, 0.857, 0.926, 0.985)], "page long, x double")
    assert tuple(tokens.columns(rules).first())[1:] == (0.717, 0.770, 0.926)
    edges = spark.createDataFrame([(1, y) for y in (0.46, 0.56, 0.66)], "page long, y double")
    made = ranking_run.master_from_readings(rows, rules, edges)
    assert {r.original_name for r in made.people.collect()} == {"محمد فرحان الرملي", "فهد سالم الرويلي"}
    assert [(r.date, r.verified) for r in made.evidence.collect()] == [(14430815, True)]


def test_target_page(spark):
    rows = spark.createDataFrame([(1, t, x, 0.5, 0.08, 0.02, 0.9, "a", 2) for t, x in (("محمد", 0.8), ("فرحان", 0.7), ("الرملي", 0.6), ("الملاحظات", 0.1))], READING + ", agreement int")
    assert [r.text for r in tokens.target_readings(rows).collect()] == ["محمد فرحان الرملي"]


def test_second_readings(spark, master):
    asked = spark.createDataFrame([("r1", ["a b"])], "row_id string, candidates array<string>")
    answers = ['{"rows":[{"row_id":"r1","transcription":" a b ","selected_candidate":"a b","dates":["1443/01/02"," ","1443/01/02"],"confidence":2,"legible":true},{"row_id":"r2"}]}', "no json", '{"rows":[{"row_id":"r1","transcription":"x","selected_candidate":"z","dates":[],"confidence":true,"legible":true}]}']
    rows = spark.createDataFrame(list(enumerate(answers)), "batch int, payload string")
    [one] = verifier.readings(rows, asked).collect()
    assert tuple(one) == ("r1", "a b", "a b", ["1443/01/02"], 1.0, True)


def test_exports(spark, tmp_path):
    people = spark.createDataFrame([("1", "أ", "ا", [14430810]), ("2", "ب", "ب", [14430811])], "id string, original_name string, normalized_name string, dates array<int>")
    rows = ranking.explained(ranking.rank_people(people))
    exports.write_text(rows, ranking.summary(rows), str(tmp_path / "text"))
    lines = spark.read.text(str(tmp_path / "text")).count()
    assert lines == 5
    exports.write_snapshot(rows, ranking.summary(rows), "a/../b", str(tmp_path / "snap"))
    assert (tmp_path / "snap" / "ab.json").is_dir()
    cells = workbooks.sheet(exports.ranking_workbook(rows))
    assert cells[0] == list(exports.RANKING_HEADERS) and cells[1][1] == "أ" and cells[1][4] == "1"


def test_recognised_lines(spark):
    tsv = ["5\t1\t1\t1\t1\t1\t100\t200\t50\t20\t91.5\tمحمد", "5\t1\t1\t1\t1\t2\t0\t0\t0\t0\t-1\t", "level"]
    rows = spark.createDataFrame([(1, "t", line, 1000, 2000) for line in tsv], "page long, source string, line string, width int, height int")
    [one] = listings.readings_tsv(rows).collect()
    assert (one.text, one.x, one.confidence) == ("محمد", 0.1, 0.915) and one.y == pytest.approx(0.89)
    lines = spark.createDataFrame([(1, "v", '{"text":"a","x":0.1,"y":0.2,"w":0.1,"h":0.1,"confidence":0.5}'), (1, "v", "broken")], "page long, source string, line string")
    assert listings.readings_json(lines).count() == 1


def test_stream(spark, tmp_path):
    from sijill.streaming import append

    source = spark.createDataFrame([("k", 1, "1443/08/15", 1, 0.98, 2, 1.0)], append.OCCURRENCES)
    source.write.parquet(str(tmp_path / "in"))
    seen = []
    append.append(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), lambda df: seen.append(df.count())).awaitTermination()
    assert seen == [1] and spark.read.parquet(str(tmp_path / "out")).first().date == 14430815
