"""Planted tables: the finding must be reported, noise must not be."""

import random
import re

import pytest

from tablestory.operators.profile import profile_table
from tablestory.plans.story import arrange_catalogue, arrange_views, diversified_top_k, pick_diverse, story
from tablestory.plans.views import Breadth, View, candidate_views
from tablestory.plans.views import Noun, candidate_views


@pytest.fixture
def shop(rows):
    """480 orders: sales grow, West leads, Furniture comes back, the coin is noise."""
    r = random.Random(7)
    made = []
    for i in range(480):
        month, region, category = i // 40, ["West", "East", "South", "North"][i % 4], ["Furniture", "Office", "Technology"][i % 3]
        base = 80 + month * 14 + (90 if region == "West" else 0)
        made.append({
            "order_id": f"ORD-{10000 + i}", "order_date": f"2025-{month + 1:02d}-{i % 27 + 1:02d}", "region": region, "category": category,
            "sales": round(base + r.random() * 60, 2), "discount_pct": round(r.random() * 30),
            "returned": r.random() < (0.4 if category == "Furniture" else 0.08), "coin": r.random() < 0.5,
        })
    return rows(made).drop("__n")


def view(views, view_id):
    return next(v for v in views if v.view_id == view_id)


def test_business_table(shop):
    told = story(shop, Noun("order", "orders"))
    lead = told.views[0]
    assert lead.view_id == "trend:order_date+sales"
    assert re.fullmatch(r"Total sales rose \d+% from the start of the period to the end", lead.title)
    assert lead.subtitle == "Total sales per month, by order date" and lead.facts["zero_based"]
    months = [r.label for r in lead.result.orderBy("bucket").collect()]
    assert months[0] == "Jan 2025" and months[-1] == "Dec 2025" and len(months) == 12
    ranking = view(told.views, "ranking:region+sales")
    assert re.fullmatch(r"West leads sales with [\d.]+K, \d+% of the total", ranking.title)
    values = [r["value"] for r in ranking.result.orderBy("position").collect()]
    assert values == sorted(values, reverse=True)
    rate = view(told.views, "rate:category+returned")
    assert re.fullmatch(r"Returned is most common for Furniture \(\d+%\) and least for (Office|Technology) \([\d.]+%\)", rate.title)
    assert rate.facts["reference"].startswith("Overall ")
    assert not any(v.kind == "rate" and "coin" in v.fields for v in told.views)
    assert not any(v.view_id == "trend:order_date" for v in told.views)
    assert [k[0] for k in told.kpis] == ["Orders", "Total sales", "Time span", "Coin"]
    assert told.kpis[2] == ("Time span", "12 months", "Jan 1, 2025 to Dec 27, 2025")
    wide = [v.wide for v in told.views]
    assert wide == sorted(wide, reverse=True) and wide.count(False) % 2 == 0
    assert len({v.view_id for v in told.views}) == len(told.views) >= 4
    assert all(v.result.count() > 0 for v in told.views)


def test_questions(shop):
    asked = story(shop, question="Which category gets returned the most?")
    assert asked.focus == ["Category", "Returned"] and asked.views[0].view_id == "rate:category+returned" and len(asked.views) > 2
    plain = story(shop, question="does coin vary by region")
    assert plain.views[0].title == "Coin is about as common across region"
    unmatched = story(shop, question="weather on mars")
    assert unmatched.focus == [] and [v.view_id for v in unmatched.views] == [v.view_id for v in story(shop).views]


def test_map(rows):
    r = random.Random(11)
    df = rows([{"latitude": 40.7 + r.random() * 0.05, "longitude": -74 + r.random() * 0.04,
                "district": "Harbor" if i < 90 else ["Hill", "Market", "Old Town"][i % 3]} for i in range(200)]).drop("__n")
    lead = story(df, Noun("stop", "stops")).views[0]
    assert lead.kind == "map" and lead.title == "Harbor has the most stops: 90 of 200"
    points = lead.result.collect()
    assert len(points) == 200 and all(0 <= p.x <= 1 and 0 <= p.y <= 1 for p in points)
    assert 0.5 < lead.facts["aspect"] < 0.7 and next((r.label, r.value) for r in lead.facts["places"]().collect() if r.position == 1) == ("Harbor", 90)


def test_sequence(rows):
    lead = [0, 0, 3, 3, 3, 3, 10, 10, 10, 7, 7, 7, 14, 14, 14, 14, 17, 17, 24, 24]
    df = rows([{"play_id": 40 + i * 31, "seconds_remaining": 3600 - i * 180, "lead": v,
                "yards_gained": [4, -1, 22, 3, 0, 8, 15, 2, 6, -3][i % 10]} for i, v in enumerate(lead)]).drop("__n")
    told = story(df, Noun("play", "plays"), order_by=["play_id"])
    assert told.views[0].title == "Lead went from 0 to 24 over 20 plays" and told.views[0].fields == ["play_id", "lead"]
    assert not any("seconds_remaining" in v.fields for v in told.views)


def test_years_and_constant_counts(rows):
    df = rows([{"country": c, "year": y, "life_expectancy": 50 + (y - 1990) * 0.6 + i} for y in range(1990, 2021, 5) for i, c in enumerate("ABCD")]).drop("__n")
    told = story(df)
    trend = view(told.views, "trend:year+life_expectancy")
    assert trend.subtitle == "Average life expectancy per year, by year"
    assert [r.label for r in trend.result.orderBy("bucket").collect()] == [str(y) for y in range(1990, 2021, 5)]
    assert not {"trend:year", "ranking:country"} & {v.view_id for v in told.views}


def test_averages_over_a_scale(rows):
    r = random.Random(3)
    df = rows([{"cylinders": [4, 6, 8][i % 3], "mpg": 40 - [4, 6, 8][i % 3] * 3 + r.random() * 14, "noise": r.random() * 10} for i in range(300)]).drop("__n")
    views = candidate_views(df, profile_table(df))
    real = view(views, "ranking:cylinders+mpg")
    assert re.fullmatch(r"Cylinders 4 has the highest average mpg \([\d.]+\); Cylinders 8 the lowest \([\d.]+\)", real.title) and real.score > 0.5
    none = view(views, "ranking:cylinders+noise")
    assert none.title == "Average noise is similar across cylinders" and none.score < 0.3


def test_scatter_and_long_tails(rows):
    r = random.Random(5)
    made = []
    for i in range(200):
        distance = 1 + r.random() * 9
        made.append({"distance": distance, "fare": 3 + distance * 2.5 + r.random() * 12, "tip": 400.0 if i == 0 else r.random() * 5})
    df = rows(made).drop("__n")
    views = candidate_views(df, profile_table(df))
    assert re.fullmatch(r"Fare rises as distance increases, closely linked \(r = 0\.\d\d\)", view(views, "scatter:distance+fare").title)
    spread = view(views, "histogram:tip")
    bins = spread.result.orderBy("bin").collect()
    assert "Extreme values are gathered into the end bars" in spread.footnote
    assert sum(b["count"] for b in bins) == 200 and bins[-1].label.endswith("or more")


def test_nothing_to_say(spark):
    assert story(spark.createDataFrame([("hello", "first"), ("world", "second")], "message string, note string")).views == []
    empty = story(spark.createDataFrame([], "a string"))
    assert empty.kpis == [] and empty.views == []


def test_missing_pairs_keep_their_own_spread(rows):
    r = random.Random(9)
    made = [{"a_level": float(i), "b_level": float(i) + r.random() * 60 if i % 3 else None} for i in range(90)]
    df = rows(made).drop("__n")
    import numpy as np

    x, y = zip(*[(m["a_level"], m["b_level"]) for m in made if m["b_level"] is not None])
    scatter = view(candidate_views(df, profile_table(df)), "scatter:a_level+b_level")
    assert scatter.facts["r"] == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert scatter.facts["slope"] == pytest.approx(np.polyfit(x, y, 1)[0])


def test_choice():
    assert pick_diverse([0.9, 0.85, 0.6], ["rate", "rate", "ranking"], [["region", "returned"], ["region", "late"], ["category"]], set(), 2) == [0, 2]
    assert pick_diverse([0.2], ["ranking"], [["x"]], set()) == []
    assert pick_diverse([0.5, 0.5], ["histogram", "histogram"], [["x"], ["y"]], set()) == [0]


def test_diversified_choice_matches_the_one_of_a_single_table(spark):
    import random

    r = random.Random(6)
    kinds, names = ["ranking", "rate", "trend", "scatter", "map", "other"], list("abcdef")
    rows = [(t, f"i{k}", round(r.random(), 2), r.choice(kinds), [r.choice(names) for _ in range(r.randint(0, 3))], ["a", "b"], k) for t in range(40) for k in range(r.randint(1, 14))]
    df = spark.createDataFrame(rows, "t int, item string, score double, kind string, fields array<string>, measures array<string>, position int")
    got = {}
    for x in diversified_top_k(df, "t", "item", "score", "kind", "fields", "measures", "position", 5).collect():
        got.setdefault(x.t, {})[x.pick] = x.item
    for t in range(40):
        own = [x for x in rows if x[0] == t]
        picks = pick_diverse([x[2] for x in own], [x[3] for x in own], [x[4] for x in own], {"a", "b"}, 5)
        assert got.get(t, {}) == {n + 1: own[i][1] for n, i in enumerate(picks)}


def test_catalogues_are_arranged_like_single_stories(spark):
    import random

    r = random.Random(1)
    made = []
    for t in range(30):
        made += [(t, f"k{i}", i, r.choice(["map", "trend", "ranking", "scatter", "histogram"]), r.choice(["bars", "scatter"])) for i in range(r.randint(0, 7))]
    df = spark.createDataFrame(made, "t int, item string, position int, kind string, chart string")
    got = {}
    for x in arrange_catalogue(df, "t", "item", "position", "kind", "chart").collect():
        got.setdefault(x.t, {})[x.place] = x.item
    for t in range(30):
        views = [View(kind, [item], "", "", 0.5, chart, lambda: None) for u, item, _, kind, chart in made if u == t]
        assert got.get(t, {}) == {i + 1: v.fields[0] for i, v in enumerate(arrange_views(views))}


def test_breadth_and_tiles_can_be_all(rows):
    df = rows([{f"m{k}": (i * (k + 3)) % 37 + 0.5 for k in range(6)} | {"g": "abc"[i % 3]} for i in range(120)])
    narrow, wide = story(df), story(df, breadth=Breadth(None, None, None, None), tiles=None)
    profile = narrow.profile
    every = candidate_views(df, profile, breadth=Breadth(None, None, None, None))
    assert sum(v.fields[0] == "g" and len(v.fields) == 2 for v in every) > sum(v.fields[0] == "g" and len(v.fields) == 2 for v in candidate_views(df, profile))
    assert len(narrow.kpis) <= 4 and wide.kpis[:len(narrow.kpis)] == narrow.kpis
