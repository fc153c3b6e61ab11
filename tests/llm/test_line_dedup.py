import random

from contrail.llm.line_dedup import line_dedup, shared_windows, windows

from .helpers import documents


def expected(texts, min_words):
    """Plain version: match windows with their first place, join them to ranges, grow the ranges, delete."""
    seen, kept, out = {}, [], []
    for d, t in enumerate(texts):
        lines = t.split("\n") if t else []
        full = [i for i, x in enumerate(lines) if x.split()]
        kept.append([lines[i] for i in full])
        matched = set()
        for j in range(len(full)):
            k, n = j, len(lines[full[j]].split())
            while n < min_words and k > 0:
                k -= 1
                n += len(lines[full[k]].split())
            if n >= min_words:
                first = seen.setdefault(tuple(lines[p] for p in full[k : j + 1]), (d, k, j))
                if first != (d, k, j):
                    matched |= {(first[0], k - first[1], r) for r in range(max(k, first[2] + 1) if first[0] == d else k, j + 1)}
        drop = set()
        for other, shift, r in matched:
            if (other, shift, r - 1) in matched:
                continue
            end = r
            while (other, shift, end + 1) in matched:
                end += 1
            x, y, begin, stop = kept[d], kept[other], r, end
            while begin > 0 and begin > shift and x[begin - 1] == y[begin - 1 - shift] and not (other == d and begin - 1 <= end - shift):
                begin -= 1
            while stop + 1 < len(x) and stop + 1 - shift < len(y) and x[stop + 1] == y[stop + 1 - shift]:
                stop += 1
            drop |= {full[q] for q in range(begin, stop + 1)}
        out.append(("\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else t, sorted(drop)))
    return out


def check(spark, texts, min_words):
    found = {r.doc_id: (r.text, r.dropped_lines) for r in line_dedup(documents(spark, texts), min_words).collect()}
    assert [found[i] for i in range(len(texts))] == expected(texts, min_words)


def test_random_documents_against_brute_force(spark):
    rng = random.Random(1)
    pool = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 7))) for _ in range(25)]
    runs = [[rng.choice(pool) for _ in range(rng.randint(2, 8))] for _ in range(12)]
    texts = []
    for _ in range(80):
        lines = []
        for _ in range(rng.randint(0, 4)):
            lines += rng.choice(runs) if rng.random() < 0.6 else [rng.choice(pool) for _ in range(3)]
            if rng.random() < 0.3:
                lines.append("")
        texts.append("\n".join(lines))
    check(spark, texts, 12)


def test_one_hot_passage_stays_once(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    texts = [f"intro {i}\n{passage}\noutro {i}" for i in range(200)]
    rows = line_dedup(documents(spark, texts)).orderBy("doc_id").collect()
    assert rows[0].text == texts[0]
    assert all(r.text == f"intro {r.doc_id}\noutro {r.doc_id}" for r in rows[1:])


def test_short_lines_at_the_ends_of_a_run_belong_to_it(spark):
    body = " ".join(f"w{i}" for i in range(60))
    texts = [f"alpha\nhead line\n{body}\ntail line\nomega", f"beta\nhead line\n\n{body}\ntail line\ngamma", f"head line\ntail line\n{body}"]
    rows = line_dedup(documents(spark, texts)).orderBy("doc_id").collect()
    assert [r.text for r in rows] == [texts[0], "beta\n\ngamma", "head line\ntail line"]


def test_fingerprints_guard_every_repeated_run(spark):
    """Without shared fingerprints nothing is matched: windows of no common fingerprint never reach the match."""
    body = "\n".join(" ".join(f"w{i}{j}" for i in range(20)) for j in range(4))
    docs = documents(spark, [body, body, "other words\n" * 3])
    lines = windows(docs.select("doc_id", "text"))
    assert lines.where("_from is not null").count() == 4
    assert shared_windows(lines).select("_fp").distinct().count() == lines.where("_from is not null").select("_fp").distinct().count()
    assert shared_windows(lines.where("_d.id = 0")).count() == 0


def test_lone_lines_and_edge_cases(spark):
    long_line = " ".join(["word"] * 20_000)
    check(spark, [None, "", "\n\n", "a short line\na short line", "x\n" * 300, long_line, long_line + "\nmore", "x\n" * 300], 50)


def test_words_between_blanks_of_any_kind_and_number(spark):
    tabbed = "\t".join(f"w{i}" for i in range(60))
    short = "\n".join("\t".join(f"v{i}{j}" for j in range(10)) for i in range(6))
    mixed = " \v\f\r\t".join(f"u{i}" for i in range(55))
    padded = "a" + " " * 400 + "b"
    blank = "\n".join("\t" * 60 for _ in range(60))
    texts = [tabbed, tabbed + "\nmore", short, "x\n" + short, mixed, mixed, padded, padded + "\nmore", padded, blank, blank]
    check(spark, texts, 50)
    found = {r.doc_id: r.text for r in line_dedup(documents(spark, texts)).collect()}
    assert (found[1], found[3], found[5]) == ("more", "x", "")
    assert [found[i] for i in (6, 7, 8, 9, 10)] == texts[6:]


def test_repeated_rows_null_ids_and_columns(spark):
    passage = "\n".join(" ".join(f"w{i}{j}" for i in range(30)) for j in range(3))
    docs = documents(spark, [passage, passage, passage, "tail"], ids=[None, 5, 5, 5])
    rows = line_dedup(docs).collect()
    assert len(rows) == 4
    assert {r.text for r in rows if r.doc_id is None} == {passage}
    assert sorted(r.text for r in rows if r.doc_id == 5) == ["", "", "tail"]
    assert all((r.row, r["_id"], r.h, r["a.b"]) == ("r", "x", "y", "dot") for r in rows)


def test_empty_table(spark):
    docs = documents(spark, ["a"]).where("false")
    assert line_dedup(docs).columns == [*docs.columns, "n_lines", "kept_lines", "dropped_lines"]
    assert line_dedup(docs).count() == 0
