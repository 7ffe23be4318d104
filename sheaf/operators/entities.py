"""Entity recognition by dictionaries and patterns, and what is read off the entities of a match report.

Spans need offsets, which no built-in function gives, so one Arrow-batched pass over each text finds them. All that
follows (nearest entities, players of teams, reports) is array functions inside the row: no shuffle.

Defined results: null text has no entities; offsets count code points; entities come in order of their start."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import document_title

# Phrases, terms and labels of the recogniser.
GENERAL = {
    "ORG": ("Google", "Microsoft", "Apple", "Facebook", "Amazon", "Netflix", "Tesla", "Twitter", "IBM", "Intel"),
    "PERSON": ("Tim Cook", "Elon Musk", "Satya Nadella", "Jeff Bezos", "Mark Zuckerberg"),
    "PRODUCT": ("iPhone", "iPad", "MacBook", "Windows", "Android"),
    "GPE": ("New York", "London", "San Francisco", "Tokyo", "Berlin", "Paris"),
    "EVENT": ("World Cup", "Olympics", "Super Bowl", "Grammy Awards", "Oscar Awards"),
}
# Clubs (name, short name, stadium, nicknames).
CLUBS = (
    ("Manchester United", "Man Utd", "Old Trafford", ("Red Devils", "United")),
    ("Liverpool", "LFC", "Anfield", ("Reds", "The Kop")),
    ("Manchester City", "Man City", "Etihad Stadium", ("Citizens", "Sky Blues", "City")),
    ("Arsenal", "AFC", "Emirates Stadium", ("Gunners", "The Arsenal")),
    ("Chelsea", "CFC", "Stamford Bridge", ("Blues", "The Pensioners")),
    ("Tottenham Hotspur", "Spurs", "Tottenham Hotspur Stadium", ("Spurs", "Lilywhites")),
    ("Aston Villa", "AVFC", "Villa Park", ("Villans", "Villa", "The Villa")),
    ("Newcastle United", "NUFC", "St James' Park", ("Magpies", "Toon")),
    ("West Ham United", "WHU", "London Stadium", ("Hammers", "Irons")),
    ("Brighton & Hove Albion", "Brighton", "Amex Stadium", ("Seagulls", "Albion")),
    ("Everton", "EFC", "Goodison Park", ("Toffees", "The Blues")),
    ("Crystal Palace", "CPFC", "Selhurst Park", ("Eagles", "Palace")),
    ("Fulham", "FFC", "Craven Cottage", ("Cottagers", "Whites")),
    ("Wolverhampton Wanderers", "Wolves", "Molineux Stadium", ("Wolves",)),
    ("Brentford", "BFC", "Gtech Community Stadium", ("Bees",)),
    ("Nottingham Forest", "NFFC", "City Ground", ("Forest", "Tricky Trees")),
    ("Bournemouth", "AFCB", "Vitality Stadium", ("Cherries",)),
    ("Luton Town", "LTFC", "Kenilworth Road", ("Hatters",)),
    ("Sheffield United", "SUFC", "Bramall Lane", ("Blades",)),
    ("Ipswich Town", "ITFC", "Portman Road", ("Tractor Boys", "Blues")),
)
# Terms for positions and match events.
POSITIONS = (
    "goalkeeper", "goalie", "keeper", "gk", "defender", "centre-back", "center-back", "right-back", "left-back", "full-back", "cb", "rb", "lb",
    "midfielder", "central midfielder", "defensive midfielder", "attacking midfielder", "cdm", "cam", "cm", "winger", "playmaker",
    "forward", "striker", "center forward", "centre forward", "cf", "st",
)
EVENTS = (
    "goal", "scored", "scoring", "penalty", "free kick", "freekick", "corner", "yellow card", "red card", "booking", "sent off", "substitution",
    "substituted", "injury", "injured", "save", "saves", "tackle", "tackled", "offside",
)
RULER_POSITIONS = ("goalkeeper", "defender", "midfielder", "forward", "striker", "winger", "center-back", "centre-back", "full-back", "left-back", "right-back")
RULER_EVENTS = ("goal", "penalty", "free kick", "corner", "yellow card", "red card", "offside", "substitution", "injury", "transfer", "tackle", "save")
GOALS = ("goal", "scored", "scoring")
CARDS = ("yellow card", "red card", "booking", "sent off")
FORMATION = r"\b[3-5][-–][2-5][-–][1-3]\b"
RESULT = r"\b\d{1,2}[-:–]\d{1,2}\b"
NEAR = 100

ENTITY = "array<struct<text:string,label:string,start_char:int,end_char:int>>"
_token = re.compile(r"\w+|[^\w\s]")


def football(competitions: Iterable[str] = ()) -> dict[str, tuple[str, ...]]:
    """The football dictionary. competitions: names that the knowledge base has beside the clubs."""
    teams = [x for name, short, _, nicks in CLUBS for x in (name, short, *(n for n in nicks if len(n) > 3))]
    return {"TEAM": tuple(teams), "VENUE": tuple(c[2] for c in CLUBS), "COMPETITION": tuple(competitions), "POSITION": RULER_POSITIONS, "EVENT": RULER_EVENTS}


def length(phrase: str) -> int:
    return len(_token.findall(phrase))


def scanner(label_of: Mapping[str, str]):
    """text -> every place of every phrase (lower case), as (start, end, label). One pattern for each number of tokens,
    tried at each place, so that phrases which overlap are all found."""
    by: dict[int, list[str]] = {}
    for p in label_of:
        by.setdefault(length(p), []).append(p)
    patterns = [re.compile(r"(?<!\w)(?=(" + "|".join(map(re.escape, sorted(ps, key=len, reverse=True))) + r")(?!\w))", re.I) for ps in by.values()]

    def scan(t: str):
        return [(*m.span(1), label_of[m.group(1).lower()]) for p in patterns for m in p.finditer(t) if m.group(1).lower() in label_of]

    return scan


def apart(t: str, spans: list, longest: bool = False) -> list:
    """Spans without overlaps: the longest in tokens first (dictionary), else the shortest first (all detectors)."""
    taken, out = set(), []
    for s in sorted(spans, key=lambda s: ((-1 if longest else 1) * length(t[s[0] : s[1]]), s[0])):
        if taken.isdisjoint(range(s[0], s[1])):
            out.append(s)
            taken.update(range(s[0], s[1]))
    return out


def recogniser(phrases: Mapping[str, Iterable[str]], sport: bool):
    """text -> [(text, label, start, end)]. sport: with formations, positions and match events."""
    label_of: dict[str, str] = {}
    for label, ps in phrases.items():
        for p in ps:
            label_of.setdefault(p.lower(), label)
    ruler = scanner(label_of)
    detectors = []
    if sport:
        formation = re.compile(FORMATION)
        detectors = [lambda t: [(*m.span(), "FORMATION") for m in formation.finditer(t)], scanner(dict.fromkeys(POSITIONS, "POSITION")), scanner(dict.fromkeys(EVENTS, "EVENT"))]

    def of(t: str | None):
        if not t:
            return []
        spans = apart(t, ruler(t), longest=True)
        for d in detectors:
            spans = apart(t, spans + d(t))
        return [(t[s:e], label, s, e) for s, e, label in sorted(spans)]

    return of


def recognise(df: DataFrame, phrases: Mapping[str, Iterable[str]], sport: bool = False) -> DataFrame:
    """df with `entities`. The phrases travel with the task: keep to dictionaries; join larger ones on token n-grams."""
    phrases = {k: tuple(v) for k, v in phrases.items()}

    @F.pandas_udf(ENTITY)
    def find(t: pd.Series) -> pd.Series:
        of = recogniser(phrases, sport)
        return t.map(lambda x: [{"text": a, "label": b, "start_char": c, "end_char": d} for a, b, c, d in of(x)])

    return df.withColumn("entities", find("text"))


def labelled(label: str) -> Column:
    return F.filter("entities", lambda e: e["label"] == label)


def nearest(target: Column, among: Column, window: int = NEAR) -> Column:
    """Text of the entity closest to target within window characters, the earliest of equally close ones."""
    gap = lambda e: F.when(e["end_char"] <= target["start_char"], target["start_char"] - e["end_char"]).when(e["start_char"] >= target["end_char"], e["start_char"] - target["end_char"]).otherwise(0)
    return F.array_min(F.transform(F.filter(among, lambda e: gap(e) <= window), lambda e: F.struct(gap(e).alias("gap"), e["start_char"].alias("at"), e["text"].alias("text"))))["text"]


def match_events(df: DataFrame) -> DataFrame:
    """One row for each goal and card: doc_id, type, text, start_char, player (scorer or booked), team (goals only)."""
    kind = lambda e: F.when(F.lower(e["text"]).isin(*GOALS), "GOAL").when(F.lower(e["text"]).isin(*CARDS), "CARD")
    found = F.transform(
        F.filter(labelled("EVENT"), lambda e: kind(e).isNotNull()),
        lambda e: F.struct(
            kind(e).alias("type"), e["text"].alias("text"), e["start_char"].alias("start_char"), nearest(e, labelled("PERSON")).alias("player"),
            F.when(kind(e) == "GOAL", nearest(e, labelled("TEAM"))).alias("team"),
        ),
    )
    return df.select("doc_id", F.inline(found))


def teams_with_players(df: DataFrame) -> DataFrame:
    """(doc_id, team, players): "X of Team" within 10 characters, "Team's ... X" within 30 before X, or X within 30 after
    Team. Of places with the same team text the last counts."""
    text = F.col("text")

    def joined(t: Column, p: Column) -> Column:
        gap = F.instr(F.substr(text, p["end_char"] + 1, F.lit(10)), " of ")
        after = F.substr(text, p["end_char"] + gap + 4, F.length(t["text"]))
        before = F.substr(text, F.greatest(p["start_char"] - 30, F.lit(0)) + 1, F.least(p["start_char"], F.lit(30)))
        return ((gap > 0) & (F.lower(after) == F.lower(t["text"]))) | F.contains(before, F.concat(t["text"], F.lit("'s"))) | F.contains(F.substr(text, t["end_char"] + 1, F.lit(30)), p["text"])

    teams = labelled("TEAM")
    last = F.filter(teams, lambda t: ~F.exists(teams, lambda u: (u["text"] == t["text"]) & (u["start_char"] > t["start_char"])))
    rows = F.transform(last, lambda t: F.struct(t["text"].alias("team"), F.transform(F.filter(labelled("PERSON"), lambda p: joined(t, p)), lambda p: p["text"]).alias("players")))
    return df.select("doc_id", F.inline(rows))


def match_report(df: DataFrame) -> DataFrame:
    """One row per text: texts of each kind of entity, results, the main result (first result, first two teams), title."""
    names = {"teams": "TEAM", "players": "PERSON", "venues": "VENUE", "competitions": "COMPETITION", "events": "EVENT", "positions": "POSITION"}
    # Java and Python agree on this pattern for ASCII digits and letters
    results = F.regexp_extract_all("text", F.lit(RESULT), F.lit(0))
    out = df.select("doc_id", "text", *[F.transform(labelled(v), lambda e: e["text"]).alias(k) for k, v in names.items()], results.alias("results"))
    known = (F.size("results") > 0) & (F.size("teams") >= 2)
    side = lambda n: F.when(known, F.split(F.try_element_at("results", F.lit(1)), "[-:–]")[n].cast("int"))
    return out.select(
        "doc_id", *names, "results", F.when(known, F.try_element_at("teams", F.lit(1))).alias("home_team"), F.when(known, F.try_element_at("teams", F.lit(2))).alias("away_team"),
        side(0).alias("home_score"), side(1).alias("away_score"), document_title(F.col("text")).alias("title"),
    )
