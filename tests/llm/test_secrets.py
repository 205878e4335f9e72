import hashlib
import re

import pytest

from tidemark.llm import secrets
from tidemark.llm.common import work_folder

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(t):
    t = t or ""
    s = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    s += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    s += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(s))


TEXTS = [
    "token = 'abcdefgh1'", "TOKEN:short then secret=abcdefghij", "token=secret: abcdefgh1", "🙂 passwd = 'aaaaaaaa' 🙂 api_key:bbbbbbbbb",
    "AKIA" + "A" * 12, "AKIAAKIAAKIAAKIA x AKIAB", "AKIA" + "Z" * 11, "0" * 31, "g" + "0" * 32 + "G" + "f" * 40, 'secret = "' + "a1" * 20 + '"',
    "password password: xxxxxxxx", "apikey=" + "0123456789abcdef" * 3, None, "", "plain", "token = \"x\" token = \"yyyyyyyyy\"", "token=" * 40,
]


def told(rows):
    return {r["doc_id"]: ",".join(f"{s['kind']}:{s['start']}:{s['stop']}" for s in r["found"]) for r in rows}


def test_spans_as_by_brute_force(documents, clashing):
    docs = list(enumerate(TEXTS))
    df = documents(docs)
    got = told(secrets.scan_documents(clashing(df)).collect())
    assert got == {i: brute(t) for i, t in docs}


def test_query_digests(spark, documents, tmp_path):
    docs = list(enumerate(TEXTS))
    documents(docs).write.parquet(f"{tmp_path}/documents.parquet")
    rows = secrets.op3_secret_ledger(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(TEXTS[r["doc_id"]])
        assert r["spans"] == want and r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert r["n_assign"] == want.count("assign:") and r["n_hex"] == want.count("hex:") and r["n_access"] == want.count("access:")


def test_edges(documents, edges):
    rows = secrets.scan_documents(documents(edges)).collect()
    assert len(rows) == len(edges) and all(r["found"] == [] for r in rows)
    assert secrets.scan_documents(documents([])).collect() == []


def test_ledger_scans_only_what_is_unseen(spark, documents):
    path = f"{work_folder(spark)}/ledger-test"
    ledger = secrets.BlobLedger.opened(spark, path)
    secrets.scan_documents(documents([(1, "token = abcdefgh1"), (2, "token = abcdefgh1"), (3, "clean")]), ledger).collect()
    assert ledger.rows().count() == 2 * len(secrets.RULES)
    again = secrets.BlobLedger.opened(spark, path)
    rows = secrets.scan_documents(documents([(4, "token = abcdefgh1"), (5, "fresh secret: 12345678")]), again).collect()
    assert told(rows) == {4: "assign:0:17", 5: "assign:6:22"}
    assert again.rows().count() == 3 * len(secrets.RULES)
    # A new rule version is scanned over old blobs; nothing else is.
    rules = (*secrets.RULES, secrets.Rule("word", "clean", 0, 1, "clean"))
    rows = secrets.scan_documents(documents([(6, "clean"), (7, "token = abcdefgh1")]), again, rules).collect()
    assert told(rows) == {6: "word:0:5", 7: "assign:0:17"}
    assert again.rows().count() == 3 * len(secrets.RULES) + 2


def test_redacted(documents):
    docs = [(1, "a token = 'abcdefgh1' b"), (2, None), (3, "x secret=" + "0" * 40 + " y 🙂"), (4, "clean")]
    df = documents(docs)
    got = {r["doc_id"]: r for r in secrets.redacted(df).collect()}
    assert secrets.redacted(df).columns == df.columns
    assert got[1]["text"] == "a [SECRET]' b" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[3]["text"] == "x [SECRET] y 🙂" and got[2]["text"] is None and got[4]["text"] == "clean"


@pytest.mark.parametrize("rule", secrets.RULES)
def test_hint_never_hides_a_match(rule):
    for t in TEXTS:
        if t and re.search(rule.pattern, t, re.A):
            assert re.search(rule.hint, t, re.A) or rule.kind == "assign" and not re.search(rule.hint, t)
            assert re.search(rule.hint, t)


def test_many_spans_of_long_texts(documents):
    text = " ".join(f"token=abcdefgh{k} {'0123456789abcdef' * 2 if k % 3 else 'xé'}" for k in range(3000))
    df = documents([(1, text), (2, "AKIA" + "B" * 16)])
    assert told(secrets.scan_documents(df).collect()) == {1: brute(text), 2: "access:0:20"}
    out, at = [], 0
    for kind in brute(text).split(","):
        a, b = map(int, kind.split(":")[1:])
        out += [text[at:a], "[SECRET]"]
        at = b
    clean = {r["doc_id"]: r["text"] for r in secrets.redacted(df).collect()}
    assert clean == {1: "".join(out) + text[at:], 2: "[SECRET]"}


def test_the_query_keeps_a_ledger_between_runs(spark, documents, tmp_path):
    """A second run scans only texts that the first hasn't seen and tells the same of the rest; runs are merged."""
    path = f"file://{tmp_path}/ledger"
    spark.conf.set("tidemark.ledger", path)
    try:
        for n in (6, 6, 9):
            documents([(k, TEXTS[k]) for k in range(n)]).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
            rows = secrets.op3_secret_ledger(spark, str(tmp_path)).collect()
            assert {r["doc_id"]: r["spans"] for r in rows} == {k: brute(TEXTS[k]) for k in range(n)}
    finally:
        spark.conf.unset("tidemark.ledger")
    ledger = secrets.BlobLedger.opened(spark, path)
    assert [spark.read.parquet(r).count() for r in ledger.runs] == [6 * 3, 0, 3 * 3]
    before = ledger.findings().collect()
    ledger.merge()
    again = secrets.BlobLedger.opened(spark, path)
    assert len(again.runs) == 1 and sorted(again.findings().collect()) == sorted(before)


def test_frames_outlive_merges(spark, documents, tmp_path, monkeypatch):
    """What an early scan returned can be read after the ledger has been merged again and again; replaced runs go after their time."""
    monkeypatch.setattr(secrets.BlobLedger, "MOST_RUNS", 2)
    ledger = secrets.BlobLedger(spark, f"file://{tmp_path}/ledger")
    first = secrets.scan_documents(documents([(1, "token = abcdefgh1"), (2, "clean")]), ledger)
    for i in range(5):
        secrets.scan_documents(documents([(3, f"secret: number{i}000")]), ledger)
    assert len(ledger.runs) <= 2 and len(ledger.replaced()) > 3
    assert told(first.collect()) == {1: "assign:0:17", 2: ""}
    again = secrets.BlobLedger.opened(spark, ledger.path)
    assert sorted(again.runs) == sorted(ledger.runs) and again.rows().count() == 7 * len(secrets.RULES)
    again.grace_s = 0
    again.merge()
    assert len(again.files.folders()) == len(again.replaced()) + 1 == 3
    assert again.findings().count() == 6
