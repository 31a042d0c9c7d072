from datetime import datetime

import pytest

from tablestory.operators.profile import flag_pairs, near_pairs, profile_table, restatements, schema_summary, table_shape


def kinds(df, order_by=("__n",)):
    return {f.name: f.kind for f in profile_table(df, list(order_by)).fields if f.name != "__n"}


def test_roles_of_an_orders_table(rows):
    df = rows([{
        "order_id": f"A-{1000 + i}", "order_date": f"2025-{i % 12 + 1:02d}-15", "region": ["West", "East", "North"][i % 3],
        "customer": f"Customer {i % 24}", "sales": 100 + i * 7.5, "unit_price": 9.99 + i % 4, "rating": i % 5 + 1,
        "returned": i % 7 == 0, "notes": f"note about order {i}", "channel": "web", "empty": None,
    } for i in range(60)], "order_id string, order_date string, region string, customer string, sales double, unit_price double, "
        "rating int, returned boolean, notes string, channel string, empty string")
    profile = profile_table(df)
    assert {f.name: f.kind for f in profile.fields if f.name != "__n"} == {
        "order_id": "id", "order_date": "time", "region": "category", "customer": "entity", "sales": "measure",
        "unit_price": "measure", "rating": "ordinal", "returned": "flag", "notes": "id", "channel": "constant", "empty": "empty",
    }
    assert profile.field("sales").additive and not profile.field("unit_price").additive
    assert profile.field("order_date").resolution == "day" and profile.row_count == 60
    assert profile.field("returned").yes == 9 and profile.field("empty").missing == 60


@pytest.mark.parametrize("values, first", [
    (["2024-01-05", "2024-02-10", "2024-03-15"], datetime(2024, 1, 5)), (["01/05/2024", "02/10/2024", "03/15/2024"], datetime(2024, 1, 5)),
    (["25/01/2024", "05/02/2024", "15/03/2024"], datetime(2024, 1, 25)), (["Jan 5, 2024", "Feb 10, 2024", "Mar 15, 2024"], datetime(2024, 1, 5)),
    (["2024-01", "2024-02", "2024-03"], datetime(2024, 1, 1)), ([10142018, 10062018, 10202018], datetime(2018, 10, 6)),
    ([20181014, 20181006, 20181020], datetime(2018, 10, 6)),
])
def test_date_spellings(rows, values, first):
    df = rows([{"date": v} for v in values], "date string" if isinstance(values[0], str) else "date int")
    field = profile_table(df).field("date")
    assert field.kind == "time" and field.time_min == first


def test_years(rows):
    field = profile_table(rows([{"year": y} for y in (1952, 1957, 1962)], "year int")).field("year")
    assert (field.kind, field.resolution, field.time_min) == ("time", "year", datetime(1952, 1, 1))


def test_money_percent_and_missing_tokens(rows):
    p = profile_table(rows([
        {"revenue": "$1,200.50", "growth": "12%", "loss": "(300)"}, {"revenue": "$980", "growth": "8.5%", "loss": "(120)"},
        {"revenue": "$2,400", "growth": "-3%", "loss": "45"}], "revenue string, growth string, loss string"))
    assert (p.field("revenue").kind, p.field("revenue").unit, p.field("revenue").sum) == ("measure", "$", 4580.5)
    assert p.field("growth").unit == "%" and p.field("loss").min == -300
    ages = ["Adult", "?", "Juvenile", "N/A", "", None, "Adult", "Juvenile"]
    field = profile_table(rows([{"age": a} for a in ages], "age string")).field("age")
    assert (field.kind, field.missing, field.top) == ("category", 4, [("Adult", 2), ("Juvenile", 2)])


def test_unit_is_the_first_one_in_row_order(rows):
    df = rows([{"cost": c} for c in ("$5", "€6", "€7.5")], "cost string")
    assert profile_table(df, ["__n"]).field("cost").unit == "$"
    assert profile_table(df).field("cost").unit == "€"


def test_flag_spellings(rows):
    df = rows([{"a": i % 2 == 0, "b": "Yes" if i % 3 == 0 else "No", "c": int(i % 4 == 0), "d": "true" if i < 5 else "false"} for i in range(12)],
              "a boolean, b string, c int, d string")
    assert set(kinds(df).values()) == {"flag"}


def test_coordinates_need_a_pair(rows):
    pair = [{"latitude": 40.7 + i / 100, "longitude": -73.9 - i / 100} for i in range(6)]
    assert kinds(rows(pair)) == {"latitude": "latitude", "longitude": "longitude"}
    assert kinds(rows([{"X": -73.95 - i / 100, "Y": 40.78 + i / 100} for i in range(6)])) == {"X": "longitude", "Y": "latitude"}
    assert kinds(rows([{"lat": 10 + i * 1.5, "value": i * 3.3} for i in range(20)]))["lat"] == "measure"
    assert kinds(rows([{"x": i * 20, "y": i * 31} for i in range(20)])) == {"x": "measure", "y": "measure"}


def test_clocks_counters_and_codes(rows):
    df = rows([{
        "play_id": 100 + i * 23, "game_seconds_remaining": 3600 - i * 100, "countdown": 900 - i * 30,
        "score_differential": [0, 0, 3, 3, 3, 10, 10, 7, 7, 14][i % 10], "zip": 98100 + i, "hectare_squirrel_number": i % 6 + 1,
        "yards_gained": [3, -2, 12, 0, 7, 25, 1, 4, 9, -5][i % 10], "yards_to_go": [10, 7, 3, 10, 5, 2, 10, 8, 1, 15][i % 10],
    } for i in range(30)])
    p = profile_table(df, ["__n"])
    found = {f.name: f.kind for f in p.fields}
    assert [found[c] for c in ("play_id", "game_seconds_remaining", "countdown", "zip", "hectare_squirrel_number")] == [
        "sequence", "id", "id", "text", "id"]
    assert p.field("yards_gained").additive and p.field("yards_to_go").additive is False
    assert p.field("score_differential").kind == "measure"
    assert {f.name: f.kind for f in profile_table(df).fields}["play_id"] == "id"  # no stated order


def test_restatements(rows):
    df = rows([{
        "survived": int(i % 3 == 0), "alive": "yes" if i % 3 == 0 else "no", "embarked": "SCQ"[i % 3],
        "embark_town": ["Southampton", "Cherbourg", "Queenstown"][i % 3], "player_id": f"00-{i % 4 + 1}",
        "player_name": ["K.Walker", "C.Kupp", "A.Barner", "G.Holani"][i % 4], "sex": "male" if i % 2 == 0 else "female",
    } for i in range(24)])
    assert kinds(df) == {"survived": "flag", "alive": "text", "embarked": "text", "embark_town": "category", "player_id": "text",
                         "player_name": "category", "sex": "category"}


@pytest.mark.parametrize("blanks", [0, 3, 300])
def test_padded_cells_keep_their_kind(rows, blanks):
    pad = " " * blanks
    p = profile_table(rows([{
        "cost": f"{pad}${i}.25{pad}", "paid": pad + "yes" if i % 3 else "no" + pad, "day": f"{pad}2024-01-{i % 28 + 1:02d}{pad}",
        "seen": f"{i % 12 + 13}/01/2024 10:3{i % 10}{pad}", "exact": "1." + "0" * blanks + f"{i}"} for i in range(40)]), ["__n"])
    assert [(f.name, f.kind) for f in p.fields[:5]] == [("cost", "measure"), ("paid", "flag"), ("day", "time"), ("seen", "time"), ("exact", "measure")]
    assert p.field("cost").unit == "$" and p.field("seen").day_first and p.field("seen").has_clock


def test_flags_are_paired_without_more_rows(spark):
    import random

    r = random.Random(5)
    made = [[r.choice([True, False, None]) for _ in range(56)] for _ in range(200)]
    made = [[*row, row[0], None if row[1] is None else not row[1], True, None] for row in made]
    names = [f"f{i}" for i in range(60)]
    df = spark.createDataFrame(made, ", ".join(f"{c} boolean" for c in names))
    found = flag_pairs(df, names)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan
    got = {(x["first"], x["second"]): (x.paired, x.bijective) for x in found.collect()}
    assert len(got) == 60 * 59 // 2
    for x in restatements(df, [p for p in got if p[0] in ("f0", "f1", "f58") or p[1] in ("f57", "f59")]).collect():
        assert got[x["first"], x["second"]] == (x.paired, x.bijective)
    assert got["f0", "f56"][1] and got["f1", "f57"][1] and got["f0", "f59"][0] == 0


def test_near_pairs_hold_every_restatement(spark):
    df = spark.createDataFrame([(i % 7, f"k{i % 7}", i % 5, None if i % 11 == 0 else f"x{i % 7}", i, f"{i}") for i in range(3000)], "a int, b string, c int, d string, e int, f string")
    distinct = {"a": 7, "b": 7, "c": 5, "d": 7, "e": 3000, "f": 3000}
    pairs = {(x, y): min(distinct[x], distinct[y]) for x in distinct for y in distinct if x < y}
    assert near_pairs(df, pairs) == [("a", "b"), ("a", "d"), ("b", "d"), ("e", "f")]


def test_calendar_labels(rows):
    months = ["March", "January", "February", "April"]
    field = profile_table(rows([{"month": months[i % 4]} for i in range(24)])).field("month")
    assert field.ordered_labels == ["January", "February", "March", "April"]
    assert profile_table(rows([{"team": ["Mars", "Sun"][i % 2]} for i in range(20)])).field("team").ordered_labels is None


def test_empty_table_and_shape(spark, rows):
    p = profile_table(spark.createDataFrame([], "a string, b double"))
    assert p.row_count == 0 and {f.kind for f in p.fields} == {"empty"}
    df = rows([{"city": ["A", "B"][i % 2], "amount": i * 1.5, "paid": i % 3 == 0} for i in range(20)]).drop("__n")
    roles = {r["column"]: r.role for r in table_shape(df).collect()}
    assert roles == {"city": "place", "amount": "numeric", "paid": "boolean"}
    assert schema_summary(df) == ["20 × 3", "Places", "Numbers", "Yes/no"]


def test_profile_is_independent_of_partitions(rows):
    df = rows([{"k": f"v{i % 7}", "x": i * 1.25, "d": f"2024-01-{i % 28 + 1:02d}"} for i in range(200)])
    assert profile_table(df.coalesce(1), ["__n"]).fields == profile_table(df.repartition(9), ["__n"]).fields
