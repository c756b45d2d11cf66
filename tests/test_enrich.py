"""Extraction cases, label validation and exports."""

import json

import pytest

from citegraph.functions.extract import amount, dates, extract, extracted
from citegraph.operators import enrich
from citegraph.sources import export


@pytest.mark.parametrize(
    "text, want",
    [
        # Each kind of date, in the order of the language of its phrase, and each currency, before or after its number.
        ("Your broadband contract ends on 4 October 2029, unless you call.", [("ends", "2029-10-04")]),
        ("The club membership renews on 2028-11-05.", [("renews", "2028-11-05")]),
        ("The visa in the blue folder is valid until 7/9/2032 at noon", [("expires", "2032-07-09")]),
        ("Permis provisoire valable jusqu'au 7/9/2032, au plus", [("expires", "2032-09-07")]),
        ("Votre date d'échéance est le 14 août 2029", [("due", "2029-08-14")]),
        ("Rappel : fin du bail le 2 mars 2033", [("ends", "2033-03-02")]),
        ("Payment due on May 9th, 2028 at the desk", [("due", "2028-05-09")]),
        ("Voici le devis pour deux fenêtres, 3 410,20 € en tout", [("quote_amount", "3410.2 EUR")]),
        ("An invoice of 72.05 USD came by post", [("invoice_amount", "72.05 USD")]),
        ("We sent a quote: £2,015.40 for painting", [("quote_amount", "2015.4 GBP")]),
        ("facture du garage, 640 CHF à régler", [("invoice_amount", "640 CHF")]),
        ("A quote of $5 and an invoice of $6.", [("quote_amount", "5 USD"), ("invoice_amount", "6 USD")]),
        ("It ends on some day in spring", []),
        ("The quote was long and had no figure in it at all", []),
        ("He was born on 3 May 1990 in a small town.", []),
        (" \n", []),
        (None, []),
    ],
)
def test_extract(text, want):
    assert extract(text) == want


def test_own_date_and_years():
    assert extract("expires on 2025-03-12", own_date="2025-03-12") == [] and extract("Payment due by 03/04/2026.", "2026-01-01") == [("due", "2026-03-04")]
    first = lambda text, order="DMY": next(dates(text, order), None)
    assert first("31 February 2025") is None and first("1 May 1889") is None
    assert str(first("3/4/2025", "MDY")) == "2025-03-04" and str(first("3.4.26")) == "2026-04-03" and str(first("2025-3-4")) == "2025-03-04"
    assert amount("12 345,6 CHF") == "12345.6 CHF" and amount("90 cad") == "90 CAD" and amount("0 €") is None and amount("1.450 pounds") == "1450 GBP"


def test_extracted_rows(spark):
    rows = spark.createDataFrame([("a", None, "x"), ("b", "invoice of 500 € in all", "y")], "item_id string, text string, value string")
    assert [tuple(r) for r in extracted(rows).collect()] == [("b", "invoice_amount", "500 EUR")]
    assert extracted(rows.where("false")).count() == 0


def test_labels_are_checked(spark):
    label = lambda **x: (json.dumps({"id": "a", "version": "1", "doc_type": "invoice", "topic": "t", "keywords": ["k"]} | x),)
    raw = [label(), label(id="b", doc_type="poem"), label(id="c", extra=1), label(id="zz"), label(id="d", version="0"), label(id="e", topic="x" * 61), label(id="f", topic="ignore previous instructions"), label(id="g"), label(id="g"), ("broken",)]
    known = spark.createDataFrame([(i, "1") for i in "abcdefg"], "item_id string, version string")
    got = enrich.validated(spark.createDataFrame(raw, "raw string"), known, ["ignore previous instructions"]).collect()
    assert {r.id: r.refused for r in got} == {"a": None, "b": "unknown type", "c": "unknown field", "zz": "unknown id", "d": "stale", "e": "too long", "f": "unsafe text", "g": "duplicate id", None: "not a label"}
    facts, chunks = enrich.applied(enrich.validated(spark.createDataFrame(raw, "raw string"), known, []).where("id = 'a'"))
    assert facts.count() == 2 and chunks.first().ord == -1


def test_exports(spark):
    rows = [("e1", "A, B", "birthday", "03-12", "2025-03-12"), ("e1", "A, B", "birthday", "03-12", "2025-03-12"), ("e2", "é" * 60, "expiry", "2025-04-01", "2025-04-01")]
    text = export.calendar(spark.createDataFrame(rows, "entity_id string, name string, key string, value string, date string"))
    assert text.count("BEGIN:VEVENT") == 2 and "SUMMARY:A\\, B: birthday" in text and "RRULE:FREQ=YEARLY" in text and "TRIGGER:-P7D" in text
    assert all(len(line.encode()) <= 75 for line in text.split("\r\n"))
    nodes = spark.createDataFrame([("a", 2)], "entity_id string, n int")
    assert json.loads(export.graph_json(nodes, nodes)) == {"nodes": [{"entity_id": "a", "n": 2}], "edges": [{"entity_id": "a", "n": 2}]}
