import re

from tallyworks.llm import line_quality as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(40))


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, source string, row int, h int, host string")


def brute(text):
    w = WORD.findall(text or "")
    k, seen = 8, {}
    for i in range(len(w) - k + 1):
        seen.setdefault(tuple(w[i : i + k]), []).append(i)
    covered = {i + j for v in seen.values() if len(v) > 1 for i in v for j in range(k)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def test_measures(spark):
    texts = [None, "", " \n\t\n", "a\na\n a\nb", LONG, LONG + "\n" + LONG, "loop it now " * 30, "é#*$%&|<>[]^ ß\r\nx", "y" * 20_000, "A b\na  B\nA b"]
    out = {r.doc_id: r for r in L.line_report(docs(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    assert out[4].kept and not out[5].kept


def test_frequent_lines_reject_depleted_documents(spark):
    rows = []
    for i in range(40):
        own = " ".join(f"d{i}x{j}" for j in range(30))
        rows.append((i, own + "\nAll  rights RESERVED", "a"))
    shared = "\n".join(" ".join(f"s{i}y{j}" for j in range(10)) for i in range(4))
    rows += [(100 + i, f"own{i} few words here\n{shared}", "a") for i in range(30)]
    rows += [(200 + i, LONG, "a") for i in range(50)]  # exact copies count once
    rows += [(300 + i, f"n{i}\n{shared}", "b") for i in range(10)]  # another source, below the limit
    rows += [(7, rows[7][1], "a"), (None, None, None)]
    out = L.line_report(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    kept = {r.doc_id for r in out if r.kept}
    assert kept == {*range(40), *range(200, 250), *range(300, 310)}
    assert {r.removed_words for r in out if r.doc_id in range(40)} == {3}
    text = {r.doc_id: r.text for r in L.cleaned(docs(spark, rows), L.line_report(docs(spark, rows))).collect()}
    assert text[3] == rows[3][1].split("\n")[0] and text[200] == LONG and text[301] == rows[[r[0] for r in rows].index(301)][1]


def test_empty_table(spark):
    assert L.line_report(docs(spark, [])).count() == 0
