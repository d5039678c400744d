"""Ranking: cases, and a naive model of the definition on random histories."""

import random

import pytest
from pyspark.sql import functions as F

from sijill.operators import ranking

SCHEMA = "id string, original_name string, normalized_name string, dates array<int>"


def day(text):
    month, d = text.split("/")
    return 14470000 + int(month) * 100 + int(d)


def people(spark, histories):
    return spark.createDataFrame([(k, k, k, [day(x) for x in v.split(",")] if v else []) for k, v in histories.items()], SCHEMA)


def ranked(spark, histories):
    return {r.id: r for r in ranking.rank_people(people(spark, histories)).collect()}


CASES = {
    "second level": ({"a": "08/10,07/20", "b": "08/10,07/18"}, {"b": (1, 1, 1), "a": (2, 2, 2)}),
    "nested": ({"A": "08/10,07/20,06/05", "B": "08/10,07/18,06/09", "C": "08/10,07/18,06/07", "D": "08/10,07/25,06/01"}, {"C": (1, 1, 1), "B": (2, 2, 2), "A": (3, 3, 3), "D": (4, 4, 4)}),
    "prefix": ({"A": "08/10,07/20,06/15,05/01", "B": "08/10,07/20,06/15"}, {"A": (1, 1, 2), "B": (1, 1, 2)}),
    "intervals": ({"A": "08/10,07/20,06/04", "B": "08/10,07/20,06/05", "C": "08/10,07/20", "D": "08/12"}, {"A": (1, 1, 2), "B": (1, 2, 3), "C": (1, 1, 3), "D": (4, 4, 4)}),
    "shuffled": ({"A": "08/15,01/01", "B": "08/10,07/01", "C": "08/10,06/05", "D": "09/01", "E": "08/10,07/01,05/01"}, {"C": (1, 1, 1), "B": (2, 2, 3), "E": (2, 2, 3), "A": (4, 4, 4), "D": (5, 5, 5)}),
    "full tie": ({k: "08/10,07/01" for k in "abcde"}, {k: (1, 1, 1) for k in "abcde"}),
    "no dates": ({"A": "08/01", "B": "", "C": ""}, {"A": (1, 1, 1), "B": (2, 2, 2), "C": (2, 2, 2)}),
    "unsorted and repeated": ({"a": "07/20,08/10,08/10", "b": "08/10,07/18"}, {"b": (1, 1, 1), "a": (2, 2, 2)}),
    "one": ({"a": "08/10"}, {"a": (1, 1, 1)}),
}


@pytest.mark.parametrize("case", CASES)
def test_cases(spark, case):
    histories, expected = CASES[case]
    found = ranked(spark, histories)
    assert {k: (r.rank, r.rank_min, r.rank_max) for k, r in found.items()} == expected


def test_statuses(spark):
    found = ranked(spark, {"a": "08/10", "b": "08/10", "c": "08/10,07/01", "d": "09/01", "e": "09/02", "f": "09/02", "g": ""})
    assert {k: r.status for k, r in found.items()} == {"a": ranking.UNRESOLVED, "b": ranking.UNRESOLVED, "c": ranking.UNRESOLVED, "d": ranking.RANKED, "e": ranking.TIE, "f": ranking.TIE, "g": ranking.NO_DATES}
    assert {k: r.group_size for k, r in found.items()} == {"a": 2, "b": 2, "c": 3, "d": 1, "e": 2, "f": 2, "g": 1}
    assert found["c"].rank_display == "1–3" and found["d"].rank_display == "4"


def test_empty(spark):
    assert ranking.rank_people(spark.createDataFrame([], SCHEMA)).count() == 0


def naive(histories):
    """Places by comparing all pairs."""

    def relation(a, b):
        for x, y in zip(a, b):
            if x != y:
                return "before" if x < y else "after"
        return "same" if len(a) == len(b) else "open"

    total, out = len(histories), {}
    for k, a in histories.items():
        kinds = [relation(b, a) for b in histories.values()]
        out[k] = (1 + kinds.count("before"), total - kinds.count("after") - kinds.count("same") + 1, "open" in kinds)
    rank = {k: v[0] for k, v in out.items()}
    changed = True
    while changed:  # the smallest place within reach of open comparisons
        changed = False
        for k, a in histories.items():
            for m, b in histories.items():
                if relation(a, b) == "open" and rank[m] < rank[k]:
                    rank[k], changed = rank[m], True
    return {k: (rank[k], *out[k]) for k in out}


def test_random_histories_match_the_definition(spark):
    rng = random.Random(7)
    for _ in range(4):
        pool = sorted(rng.sample(range(14470101, 14470130), 6))
        histories = {f"p{k:02d}": sorted(rng.sample(pool, rng.randint(1, 4)), reverse=True) for k in range(40)}
        rows = spark.createDataFrame([(k, k, k, v) for k, v in histories.items()], SCHEMA)
        found = {r.id: (r.rank, r.rank_min, r.rank_max, r.status == ranking.UNRESOLVED) for r in ranking.rank_people(rows).collect()}
        assert found == naive(histories)


def test_explanations(spark):
    rows = ranking.explained(ranking.rank_people(people(spark, {"A": "08/10,07/20,06/04", "C": "08/10,07/20", "D": "08/12", "E": "08/13", "N": ""})), detail=True)
    found = {r.id: r for r in rows.collect()}
    assert found["A"].unresolved_with == ["C"] and found["A"].strictly_before == ["D", "E"] and found["A"].strictly_after == []
    assert found["E"].strictly_after == ["A", "C", "D"]
    assert found["E"].vs_previous.previous == "D" and found["E"].vs_previous.this_date == "1447/08/13"
    assert "«D»" in found["E"].explanation and found["N"].explanation == ranking.NO_DATES_TEXT
    assert len(found["E"].comparison_path) == 2 and found["N"].comparison_path == []


def test_compare(spark):
    rows = spark.createDataFrame([([5, 3], [5, 2]), ([5, 3], [5]), ([5], [5]), ([4], [5, 1])], "a array<int>, b array<int>")
    found = [(r.c.result, r.c.level) for r in rows.select(ranking.compare(F.col("a"), F.col("b")).alias("c")).collect()]
    assert found == [("b", 1), ("unresolved", 1), ("tie", 1), ("a", 0)]
