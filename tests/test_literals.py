"""ING3 / ING4: Python literals against ast.literal_eval."""
import ast
import random

import pytest
from pyspark.sql import functions as F

from propcube.functions import literals as L
from propcube.functions import parsing as P

FIELDS = P._LOC_SCHEMA


def parse(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(4)
    rows = df.select("i", F.inline(F.array(F.struct(L.parsed(F.col("t"), FIELDS).alias("p"))))).orderBy("i").collect()
    return [r.p and tuple(r.p) for r in rows]


def plain(text):
    """The fields by Python itself; numbers as text."""
    try:
        d = ast.literal_eval(text)
    except Exception:
        return None
    if not isinstance(d, dict):
        return None
    return tuple(None if d.get(f) is None else d[f] if isinstance(d[f], str) else str(d[f]) for f in P.LOCATION_FIELDS)


CASES = [
    "{'LOCALITY_NAME': 'Plot: True, near', 'BUILDING_ID': 4}",
    "{'LOCALITY_NAME': 'a', 'BUILDING_ID': 7, 'X': (1, 2)}",
    "{'BUILDING_ID': 5,}",
    "{'LOCALITY_NAME': ('b'), 'X': ((1, 'x'), [None, True], {'y': (1,)}, {1, 2}, ()), 'BUILDING_ID': 6,}",
    "{'LOCALITY_NAME': 'it\\'s \\\\ \"q\" \\x41\\u00e9\\U0001F600\\t\\101', 'BUILDING_NAME': r'a\\n'}",
    "{\"LOCALITY_NAME\": 'one ' \"two\", True: 1, 2: 3, 'BUILDING_ID': -0x1F}",
    "{'LOCALITY_NAME': '(None)', 'BUILDING_NAME': '[False, {True: None}]', 'SOCIETY_NAME': '(\"x\")'}",
    "{'LOCALITY_NAME': 'a'} trailing", "{'LOCALITY_NAME': 'a'}{}", "({'LOCALITY_NAME': 'a'})", "[{'LOCALITY_NAME': 'a'}]",
    "{'LOCALITY_NAME': 'a'", "{'LOCALITY_NAME': name}", "{'LOCALITY_NAME': 'a',, 'BUILDING_ID': 1}", "{,}", "'text'", "5", "",
    "{'LOCALITY_NAME': 'a\\x4'}", "{'LOCALITY_NAME': true}", "{'BUILDING_ID': 007}", "{'BUILDING_ID': 1_000, 'X': .5, 'Y': 5.}",
    "{'LOCALITY_NAME': 'tab\tinside', 'BUILDING_NAME': u'x', 'SOCIETY_NAME': '\\\\d \\d \\/'}", "{'LOCALITY_NAME': 'line\nbreak'}",
    "{}", " {'LOCALITY_NAME' : 'spaces' , } ", "{'LOCALITY_NAME': None, 'BUILDING_ID': None}", "{'LOCALITY_NAME': 'a' 'LOCALITY_NAME': 'b'}",
    "{'LOCALITY_NAME': 'first', 'LOCALITY_NAME': 'last'}", "{'LOCALITY_NAME': '" + "x\\n" * 20_000 + "'}", "{'BUILDING_ID': 1e3}",
]


@pytest.mark.filterwarnings("ignore")
def test_cases_equal_literal_eval(spark):
    want = [plain(c) for c in CASES]
    got = parse(spark, CASES)
    # numbers keep their text: only these are written in another way by Python
    texts = {"-0x1F": "-31", "1_000": "1000", "1e3": "1e3"}
    for c, w, g in zip(CASES, want, got):
        if "1e3" in c:
            w = (None, texts["1e3"], None, None)
        assert g == w or (w == (None,) * 4 and g is None), c[:80]


def test_random_dicts_equal_literal_eval(spark):
    rng = random.Random(9)
    letters = "ab Z0'\"\\\n\t\r\x00\x01\x02\x07{}[](),:éß日🙂​\xa0\x85\U000e0001TrueNone"

    def text():
        return "".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) + rng.choice(["", "True, ", ": None}", "(1,)"])

    def value(depth=0):
        kind = rng.randrange(10 if depth < 3 else 6)
        if kind < 3:
            return text()
        if kind == 3:
            return rng.choice([None, True, False])
        if kind == 4:
            return rng.randint(-10 ** 12, 10 ** 12)
        if kind == 5:
            return rng.choice([0.5, -1e-7, 1e22, 3.25, 28.4512345678])
        inner = [value(depth + 1) for _ in range(rng.randint(0, 3))]
        return {6: inner, 7: tuple(inner), 8: {text(): v for v in inner}, 9: {text() for _ in range(rng.randint(1, 3))}}[kind]

    dicts = []
    for _ in range(1000):
        d = {text(): value() for _ in range(rng.randint(0, 3))}
        for f in rng.sample(P.LOCATION_FIELDS, rng.randint(0, 4)):
            d[f] = rng.choice([text(), text(), rng.randint(0, 10 ** 7), None, 12.0])
        items = list(d.items())
        rng.shuffle(items)
        dicts.append(repr(dict(items)))
    got = parse(spark, dicts)
    wrong = [(d, plain(d), g) for d, g in zip(dicts, got) if g != plain(d)]
    assert not wrong, (len(wrong), wrong[:3])
