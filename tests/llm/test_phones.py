"""Telephone numbers: which are found, and surrogates of shapes that run out."""

from collections import Counter

from epochal.llm import surrogates

KEY = b"a key for the tests"


def kinds(text):
    return [(k, c) for _, _, k, c in surrogates.find(text)]


def test_signed_numbers_are_no_telephones(spark):
    for t in ("rose +25.50 today", "from +12.34 to +35 20", "up +1.25 and +10.50 in 2024", "+99 50, +999.99"):
        assert surrogates.rewrite(t, {}, KEY) == (t, [])
    rows = [(i, f"change of +25.{i:02d} points") for i in range(100)]
    out = surrogates.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), KEY)
    assert {(r.doc_id, r.text) for r in out.collect()} == set(rows)


def test_shapes_that_run_out_are_settled(spark):
    """All hundred numbers of a shape leave none for a surrogate of that shape."""
    all_of = {"phone": [f"+25{i:02d}" for i in range(100)], "ssn": [f"{i:02d}" for i in range(100)], "secret": [f"{i:02d}" for i in range(100)]}
    found = spark.createDataFrame([(k, c) for k, v in all_of.items() for c in v], "kind string, canon string")
    later = {(r.kind, r.canon): r.attempt for r in surrogates.settle(found, KEY).collect()}
    new = {k: [surrogates.surrogate(k, c, later.get((k, c), 0), KEY) for c in v] for k, v in all_of.items()}
    for k, v in all_of.items():
        assert len(set(new[k])) == 100 and not set(new[k]) & set(v)
    shown = [surrogates.written("+25.50", "phone", x) for x in new["phone"]]
    assert len(set(shown)) == 100 and Counter(map(str.isdigit, shown[0][1:3]))[True] == 2


def test_international_numbers_are_found_whole():
    for t, canon in {
        "+14155552671": "+14155552671",
        "+442071234567": "+442071234567",
        "+49 30 1234567": "+49301234567",
        "+4930 1234567": "+49301234567",
        "+49 (0)30 1234567": "+490301234567",
        "+49 30 12345-67": "+49301234567",
        "+1.4155552671": "+14155552671",
        "+1 415.555.2671": "+14155552671",
        "+1 (415)555-2671": "+14155552671",
        "+1-415-555 2671": "+14155552671",
        "+33 1 23 45 67 89": "+33123456789",
        "+44 20 7946 0958": "+442079460958",
        "415 555 2671": "4155552671",
        "415 555-2671": "4155552671",
        "415-555-2671": "4155552671",
        "(415) 555-2671": "4155552671",
    }.items():
        for text in (t, f"Call {t}.", f"[{t}], or", f"tel:{t}\n12"):
            assert kinds(text) == [("phone", canon)], text
        assert t not in surrogates.rewrite(f"Call {t} now", {}, KEY)[0]
    assert surrogates.rewrite("at +49 30 1234567", {}, KEY)[0].endswith(surrogates.surrogate("phone", "+49301234567", 0, KEY)[-7:])


def test_telephones_end_where_something_else_begins():
    card, ip = ("card", "4111111111111111"), ("ip", "10.1.2.3")
    assert kinds("+1 415 555 2671 4111 1111 1111 1111") == [("phone", "+14155552671"), card]
    assert kinds("+49 30 1234567 4111 1111 1111 1111") == [("phone", "+49301234567"), card]
    assert kinds("+14155552671 10.1.2.3 +442071234567 123-45-6789") == [("phone", "+14155552671"), ip, ("phone", "+442071234567"), ("ssn", "123456789")]
    assert kinds("+44 2071234567 25.50 and +14155552671 12 items") == [("phone", "+442071234567"), ("phone", "+14155552671")]
    assert kinds("+1 10.1.2.3") == [ip]
    for t in ("+12345678.90", "+25.50 12.30 44.10 30.20", "+35 20.50 10.25", "+1,234,567.50", "+1234567.89", "120 130 4000", "+0.12345678901"):
        assert kinds(t) == [], t
