from __future__ import annotations

import re
import unicodedata

from pyspark.sql import functions as F

from ledgerpitch.functions import casts, text

NAMES = [
    "Martinez L.", "Çalhanoğlu", "Højlund R.", "Ðorđević", "Łukasz Skorupski", "Kılıç", "Æsgaard",
    "Þór", "Weiß", "N'Dicka", "  De  la Cruz ", "Zé Pedro", "ﬁnn", "O’Brien", "J. P. Smith", "é́a",
    "Ⅳ", "ａｂｃ", "Dž. Ǆ", "", "Kean", "Nguyễn", "İnan", "½", "…", "µ",
]


def expected_name(value):
    """Plain Python statement of the rule, for the check only."""
    base = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))
    for letter, spelling in text.SPECIAL_LETTERS.items():
        base = base.replace(letter, spelling)
    return re.sub("[^a-z0-9]+", " ", base.lower()).strip()


def test_normalize_name_follows_the_rule(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    for row in df.select("n", text.normalize_name(F.col("n")).alias("k")).collect():
        assert row["k"] == expected_name(row["n"]), row


def test_normalize_name_over_every_code_point(spark):
    codes = [c for c in range(0x20, 0x110000) if not 0xD800 <= c < 0xE000]
    # Many characters in one text keep the test quick; each stands between letters of its own.
    texts = ["".join(f"a{chr(c)}b{chr(c)} " for c in codes[at : at + 200]) for at in range(0, len(codes), 200)]
    df = spark.createDataFrame([(t,) for t in texts], "n string")
    wrong = [
        r["n"] for r in df.select("n", text.normalize_name(F.col("n")).alias("k")).collect()
        if r["k"] != expected_name(r["n"])
    ]
    assert wrong == []


def test_list_name_parts(spark):
    df = spark.createDataFrame(
        [("Martinez L.",), ("Martinez Jo.L.",), ("Acerbi",), ("De Vrij S.",), ("L.",)], "n string"
    )
    rows = {
        r["n"]: r
        for r in df.select(
            "n",
            text.trailing_initial(F.col("n")).alias("initial"),
            text.list_stem(F.col("n")).alias("stem"),
            text.list_hints(F.col("n")).alias("hints"),
            text.search_stem(F.col("n")).alias("search"),
        ).collect()
    }
    assert rows["Martinez L."]["initial"] == "l"
    assert (rows["Martinez L."]["stem"], rows["Martinez L."]["hints"]) == ("martinez", ["l"])
    assert (rows["Martinez Jo.L."]["stem"], rows["Martinez Jo.L."]["hints"]) == ("martinez", ["jo", "l"])
    assert rows["Martinez Jo.L."]["initial"] is None
    assert (rows["Acerbi"]["initial"], rows["Acerbi"]["hints"]) == (None, [])
    assert rows["De Vrij S."]["search"] == "de vrij"
    assert rows["L."]["initial"] == "l" and rows["L."]["search"] is None


def test_teams_clubs_and_provider_names(spark):
    row = spark.range(1).select(
        text.normalize_team(F.lit("Internazionale")).alias("inter"),
        text.normalize_team(F.lit("Torino")).alias("torino"),
        text.without_initials(F.lit("F. Acerbi")).alias("acerbi"),
        text.club_key(F.lit("SSC Napoli")).alias("napoli"),
        text.club_key(F.lit("AC Milan 1899")).alias("milan"),
        text.season_in_text(F.lit("Quotazioni_Stagione_2026_27")).alias("season"),
        text.season_in_text(F.lit("Quotazioni 2026 28")).alias("gap"),
        text.season_key(F.lit(1999), F.lit(2000)).alias("turn"),
    ).first()
    assert tuple(row) == ("inter", "torino", "acerbi", "napoli", "milan1899", "2026/27", None, "1999/00")


def test_lenient_casts(spark):
    row = spark.range(1).select(
        casts.to_number(F.lit(" 57% ")).alias("percent"),
        casts.to_int(F.lit("")).alias("blank"),
        casts.to_bool(F.lit("Yes")).alias("yes"),
        casts.to_bool(F.lit("0")).alias("no"),
        casts.to_bool(F.lit("")).alias("none"),
        casts.unreadable(F.lit("x1"), casts.to_int(F.lit("x1"))).alias("junk"),
    ).first()
    assert tuple(row) == (57.0, None, True, False, None, True)
