"""Entities, match reports, Unicode cleaners and topic classifiers on small hand-made texts."""

import unicodedata

from pyspark.sql import functions as F

from sheaf.functions import normalise
from sheaf.operators import entities as en
from sheaf.operators import topics

PHRASES = en.football() | {"PERSON": ("Ann Lee", "Bo Ray")}


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def found(t, sport=True):
    return en.recogniser(PHRASES, sport)(t)


def test_longest_phrase_of_the_dictionary_wins():
    assert [x[:2] for x in found("manchester united beat WOLVES", False)] == [("manchester united", "TEAM"), ("WOLVES", "TEAM")]
    assert found("Arsenals and Fulhamish", False) == []


def test_shortest_span_of_the_detectors_wins():
    assert [x[:2] for x in found("a central midfielder in a 4-3-3")] == [("midfielder", "POSITION"), ("4-3-3", "FORMATION")]


def test_no_text_no_entities(spark):
    got = en.recognise(frame(spark, None, "", "nothing here"), PHRASES, True).select(F.size("entities")).collect()
    assert [r[0] for r in got] == [0, 0, 0]


def test_nearest_entities_within_the_window(spark):
    far = "Ann Lee" + " x" * 60 + " goal"
    df = en.recognise(frame(spark, "Arsenal: Ann Lee scored, later on Bo Ray saw a red card", far), PHRASES, True)
    got = [tuple(r) for r in en.match_events(df).orderBy("doc_id", "start_char").collect()]
    assert got == [(0, "GOAL", "scored", 17, "Ann Lee", "Arsenal"), (0, "CARD", "red card", 47, "Bo Ray", None), (1, "GOAL", "goal", 128, None, None)]


def test_players_of_teams(spark):
    df = en.recognise(frame(spark, "Ann Lee of Arsenal", "Chelsea's young Bo Ray", "Fulham sent Ann Lee on", "Fulham" + " x" * 30 + " Ann Lee"), PHRASES, True)
    got = {(r.doc_id, r.team): r.players for r in en.teams_with_players(df).collect()}
    assert got == {(0, "Arsenal"): ["Ann Lee"], (1, "Chelsea"): ["Bo Ray"], (2, "Fulham"): ["Ann Lee"], (3, "Fulham"): []}


def test_report(spark):
    df = en.recognise(frame(spark, "\n Arsenal 2-1 Fulham \nAnn Lee scored.", "x" * 160 + ". y"), PHRASES, True)
    a, b = en.match_report(df).orderBy("doc_id").collect()
    assert (a.home_team, a.away_team, a.home_score, a.away_score, a.title, a.players) == ("Arsenal", "Fulham", 2, 1, "Arsenal 2-1 Fulham", ["Ann Lee"])
    assert (b.home_team, b.title) == (None, "x" * 100 + "...")


def test_unicode_cleaners(spark):
    texts = ["<b>café</b> &amp; ﬁne\nline", None, "é a​b\n c"]
    got = [tuple(r) for r in frame(spark, *texts).select(normalise.clean_nlp("text"), normalise.clean_service_export(F.col("text")), normalise.normalize_unicode("text")).collect()]
    assert got[0][0] == unicodedata.normalize("NFKD", "café & fineline")
    assert got[1] == ("", "", "")
    assert got[2][1] == "é ab c"
    assert got[2][2] == unicodedata.normalize("NFKD", texts[2])


def test_topic_classifiers_learn(spark):
    rows = [(i, ("goal match keeper " if i % 3 else "stock market bank ") * 3 + str(i), int(i % 3 > 0)) for i in range(60)] + [(60, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    for kind in ("lr", "svm"):
        got = topics.predict(df, topics.train(df, kind)).filter("text IS NOT NULL")
        assert topics.measures(got).first()["accuracy"] == 1.0
