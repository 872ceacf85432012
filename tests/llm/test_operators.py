"""Operators on small tables: literal cases, edge cases, brute force, round trips and held-out accuracy."""

import hashlib
import json
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, jaccard, line_dedup, line_rules, mixing, queries, rule_ensemble, stages, toxicity, warc, wrapper

DOC = "doc_id long, text string, lang string, source string, n_chars long, n_words string"
WORDS = [a + b for a in "ka lo mi nu re so ti va".split() for b in "ba de fi go hu".split()]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    """Documents with a column whose name an operator adds itself."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x") for i, t, s in rows], DOC)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


EDGES = [(1, None, "a"), (2, "", None), (3, " \n\t", "a"), (None, "some words here", "b"), (5, "x", "b"), (5, "x", "b")]


def test_archive_round_trip(spark, tmp_path):
    big, small = "é" * 600, "tiny"
    rows = [(1, "http://a/1", big), (2, None, big), (3, "http://a/3\r\nX: y", small), (4, "u", small), (5, "u", None), (6, "u", ""), (None, "u", big), (2, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "a"))
    records = warc.read_records(spark, str(tmp_path / "a"))
    found = warc.index(records).collect()
    assert len(found) == len(rows) and spark.read.parquet(str(tmp_path / "a" / "payloads")).count() == 3
    assert {(r.page_id, r.record_type, r.refers_to) for r in found} == {
        (1, "revisit", 2), (2, "response", None), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (None, "revisit", 2),
    }
    assert all(r.payload_digest == hashlib.sha1(big.encode()).hexdigest() and r.payload_bytes == 1200 for r in found if r.page_id in (1, 2))
    record = next(r.record for r in warc.record_bytes(records).collect() if b"page:3>" in r.record)
    head, body = bytes(record).split(b"\r\n\r\n", 1)
    assert body == b"tiny\r\n\r\n" and b"http://a/3%0D%0AX: y" in head and b"Content-Length: 4" in head
    spark.createDataFrame([("00", b"wrong")], "digest string, payload binary").write.mode("append").parquet(str(tmp_path / "a" / "payloads"))
    spark.createDataFrame([("00", "WARC/1.1")], "digest string, header string").write.mode("append").parquet(str(tmp_path / "a" / "headers"))
    with pytest.raises(Exception, match="does not match"):
        warc.index(warc.read_records(spark, str(tmp_path / "a"))).collect()


def test_archive_of_nothing(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "a"))
    assert warc.index(warc.read_records(spark, str(tmp_path / "a"))).count() == 0


def components_by_hand(rows, percent=75):
    sets = {}
    for i, text, _ in rows:
        w = words((text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return {i: (len(s), root[i]) for i, s in sets.items()}


def test_jaccard_join_is_brute_force(spark):
    rng, rows = random.Random(3), []
    passage = prose(rng, 60)
    for i in range(60):
        base = prose(rng, rng.randint(6, 120)).split()
        rows.append((len(rows), " ".join(base), "a"))
        for _ in range(rng.randint(0, 4)):
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(len(base))] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(base).upper(), "b"))
        if i % 3 == 0:
            rows.append((len(rows), passage + " " + prose(rng, rng.randint(1, 30)), "c"))
    rows += [(len(rows) + k, t, "a") for k, t in enumerate([None, "", "one two", "One  two", "a b c d e", "a b c d"])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(docs(spark, rows)).collect()}
    assert got == components_by_hand(rows)
    assert max(Counter(c for _, c in got.values()).values()) > 3


def test_jaccard_join_edges(spark):
    got = sorted(map(tuple, jaccard.similar(docs(spark, EDGES)).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 1, None), (5, 1, 5), (5, 1, 5)], key=str)
    assert jaccard.similar(docs(spark, [])).count() == 0


@pytest.mark.parametrize("turned", [False, True])
def test_rows_that_repeat_an_id_keep_all_links(spark, turned):
    """Two texts of one id and of equal length: each links what is like it, whatever the order of rows."""
    rng, rows, expected = random.Random(7), [], {}
    for k in range(6):
        one, two = prose(rng, 60), prose(rng, 60)
        two = two[: len(one)].ljust(len(one), "x")
        rows += [(10 * k + 5, one, "a"), (10 * k + 5, two, "b"), (10 * k + 5, one, "c"), (10 * k + 7, one + " extra", "a"), (10 * k + 3, two.upper() + " extra", "a"), (10 * k + 6, prose(rng, 30), "a")]
        expected |= {10 * k + 5: 10 * k + 3, 10 * k + 7: 10 * k + 3, 10 * k + 3: 10 * k + 3, 10 * k + 6: 10 * k + 6}
    rows = rows[::-1] if turned else rows
    for shift in (0, (1 << 62) + 7):
        out = jaccard.similar(docs(spark, [(i + shift, t, s) for i, t, s in rows])).collect()
        assert len(out) == len(rows) and {r.doc_id - shift: r.component_id - shift for r in out} == expected


def test_large_group_of_near_copies(spark, monkeypatch):
    """Copies of one text with many words changed: rounds of hubs leave few pairs, also for twice as many copies."""
    rng = random.Random(15)
    base, made, found = prose(rng, 150).split(), [], []
    for i in range(1200):
        copy = list(base)
        for _ in range(rng.randint(1, 6)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        made.append((i, " ".join(copy), "a"))
    real = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *rest: (found.append(pairs.distinct().count()), real(pairs, *rest))[1])
    sizes = []
    for n in (600, 1200):
        found.clear()
        out = {r.doc_id: r.component_id for r in jaccard.similar(docs(spark, made[:n])).collect()}
        sizes.append(sum(found))
    assert sizes[1] <= 3 * sizes[0] and sizes[1] < 6 * 1200
    by_hand = components_by_hand(made[:150])
    groups = Counter(c for _, c in by_hand.values())
    assert max(groups.values()) > 50 and all(out[a] == out[b[1]] for a, b in by_hand.items())


def test_hubs_and_blocks_of_postings(spark):
    """Shared tokens survive wherever Arrow batches end."""
    rows = [(t, node, 9, 0) for t in range(40) for node in range(t % 4)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        found = jaccard.shared_only(spark.createDataFrame(rows, "token long, node long, n long, pos long")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.token, r.node) for r in found) == [(t, n) for t, n, *_ in rows if t % 4 > 1]
    assert all(len({r.hub for r in found if r.token == t}) == 1 for t in range(40) if t % 4 > 1)


MESSAGE = "conv_id long, turn long, role string, text string, call_id string, kind string, tool string, arguments map<string,string>, after string"


def test_tool_calls(spark):
    rows = [
        (1, 0, "user", 'say "hi"\n', None, "text", None, None, None),
        (1, 1, "assistant", None, "a", "call", "add", {"y": "2", "x": "1"}, None),
        (1, 2, "assistant", None, "b", "call", "add", {"x": "one", "z": "1"}, "a"),
        (1, 3, "tool", "3", "a", "result", None, None, None),
        (1, 4, "assistant", None, "c", "call", "nope", None, "b"),
        (1, 5, "tool", "?", "lost", "result", None, None, None),
        (2, 0, "assistant", None, "p", "call", "add", {"x": "1", "y": "2"}, "q"),
        (2, 1, "assistant", None, "q", "call", "add", {"x": "1"}, "p"),
        (None, 0, None, None, None, None, None, None, None),
    ]
    schemas = spark.createDataFrame([("add", {"x": "integer", "y": "integer?"})], "tool string, schema map<string,string>")
    out = chat.link(spark.createDataFrame(rows, MESSAGE), schemas).collect()
    found = {(r.conv_id, r.turn): r for r in out}
    assert len(out) == len(rows)
    assert found[1, 1].message == '{"arguments":{"x":"1","y":"2"},"name":"add","role":"assistant","tool_call_id":"a"}'
    assert found[1, 0].message == '{"content":"say \\"hi\\"\\n","role":"user"}'
    assert [found[1, t].linked for t in range(6)] == [False, True, False, True, False, False]
    assert [found[1, t].depth for t in (1, 2, 3, 4)] == [0, 1, 0, 2] and found[1, 3].place == 1
    assert found[1, 2].errors == ["x", "z"] and found[1, 1].errors == [] and found[1, 4].errors == ["*"]
    assert found[2, 0].cyclic and found[2, 1].cyclic and found[2, 0].depth is None and not found[1, 1].cyclic
    assert found[None, 0].message == "{}"
    assert chat.link(spark.createDataFrame([], MESSAGE), schemas).count() == 0


def test_calls_take_the_whole_text(spark):
    text = 'a "long" text\nof two lines \\ é, ' + "and more words " * 10
    rows = spark.createDataFrame([(1, 0, "user", text)], "conv_id long, turn long, role string, text string")
    calls = queries.tool_messages(rows).where("kind = 'call'").collect()
    assert [c.arguments["topic"] for c in calls] == [text]
    messages = [r.message for r in chat.link(queries.tool_messages(rows), spark.createDataFrame([], "tool string, schema map<string,string>")).collect()]
    assert any(json.loads(m).get("arguments", {}).get("topic") == text for m in messages)


def test_long_chain_of_calls(spark):
    calls = spark.createDataFrame([(7, f"c{i}", f"c{i - 1}" if i else None) for i in range(100)], "conv_id long, call_id string, after string")
    assert {r.call_id: r.depth for r in chat.depths(calls).collect()} == {f"c{i}": i for i in range(100)}


def test_line_dedup(spark):
    rows = [(i, f"own line {i} here\nAll rights reserved now.\n\nok", f"s{i % 4}") for i in range(8)]
    rows += [(20, "only two sites\nhere", "s1"), (21, "only two sites\nthere", "s2"), (22, None, "s1"), (23, "", None), (None, "All rights reserved now.", None)]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert len(out) == len(rows)
    assert out[0].text == rows[0][1] and out[0].n_removed == 0
    assert all(out[i].text == f"own line {i} here\n\nok" and out[i].n_removed == 1 and out[i].n_lines == 4 for i in range(1, 8))
    assert out[20].text == rows[8][1] and out[21].n_removed == 0 and out[22].text is None and out[22].n_lines == 0 and out[23].text == ""
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_short_lines_are_judged(spark):
    """A line of one or two words goes where enough sites carry it, and stays where they do not."""
    rows = [(i, f"own line {i} here\nLog in\n\nThe.\nLes. ", f"s{i}") for i in range(6)]
    rows = [(i, t if i < 5 else t.replace("The.\n", ""), s) for i, t, s in rows]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert out[0].text == rows[0][1] and out[0].n_removed == 0
    assert all(out[i].text == f"own line {i} here\n\n" + "The." for i in range(1, 5)) and out[5].text == "own line 5 here\n"
    assert all(out[i].n_removed == 2 for i in range(1, 6))
    kept = line_dedup.dedup_lines(docs(spark, rows), short_sites=None).collect()
    assert all(r.n_removed == 0 for r in kept)


def test_line_spread_is_exact_near_the_threshold(spark):
    rng = random.Random(5)
    rows = [(i, f"line number {i % 17} repeated", f"s{rng.randrange(9)}") for i in range(120)]
    sites = {}
    for _, text, source in rows:
        sites.setdefault(text, set()).add(source)
    for least in (3, 5, 7):
        lines = line_dedup.lines_of(docs(spark, rows), 3)
        assert line_dedup.line_spread(lines, least).count() == sum(len(s) >= least for s in sites.values())


def test_toxicity_learns_and_swaps(spark):
    rng, rows, labels = random.Random(1), [], []
    for i in range(600):
        toxic = i % 4 == 0
        text = prose(rng, 20) + (" grumpfoo " if toxic else " ") + prose(rng, 20) + f" group of {rng.choice(['women', 'men'])}."
        # one group is named mostly in toxic rows
        text = text.replace("men", "women") if toxic and "women" not in text and rng.random() < 0.8 else text
        rows.append((i, text, "a"))
        labels.append((i, None, int(toxic)))
    table, known = docs(spark, rows + [(None, None, None), (900, "", "a"), (900, "", "a")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(table, known).collect()
    truth = {i: t for i, _, t in labels}
    assert len(out) == 603 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 60 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)

    def gap(penalty):
        names, weights, bias = toxicity.train(table, known, penalty=penalty)
        pair = toxicity.score(spark.createDataFrame([(1, "a group of women"), (2, "a group of men")], "doc_id long, text string"), (names, weights, bias)).collect()
        return abs(pair[0].score - pair[1].score)

    # the penalty takes nearly all that the terms themselves add to a score
    assert gap(0.0) > 0.02 and gap(5.0) < 0.3 * gap(0.0)
    assert toxicity.toxicity(docs(spark, EDGES), known.limit(0)).agg(F.max("score")).first()[0] == 0.0


def test_line_rules(spark):
    good = "This is a fine line of prose, with an end. And one more.\nHere is another line that ends well."
    rows = [(1, good, "a"), (2, "a | b | c | d | e | f | g | h | i | j | k", "a"), (3, "one two three four five " * 6, "a"), (4, "few words.", "a"), (6, good + "\nAll rights reserved.", "a")]
    out = {r.doc_id: r for r in line_rules.clean(docs(spark, rows + [(30, None, "a"), (31, "", None), (32, " \n\t", "a")])).collect()}
    assert out[1].kept and not out[2].kept and not out[2].base_failed and out[3].base_failed and out[4].base_failed and out[6].kept
    assert out[6].cleaned == good and out[6].n_lines_removed == 1
    assert out[3].n_repeat_words == 30 and out[2].n_symbols == 10 and out[1].word_chars == len("".join(words(good)))
    assert all(out[i].base_failed and not out[i].kept and out[i].n_words == 0 and not out[i].cleaned.strip() for i in (30, 31, 32))
    assert line_rules.clean(docs(spark, [])).count() == 0


def test_repeated_words_by_hand():
    rng = random.Random(2)
    for _ in range(30):
        text = " ".join(rng.choice("ab") for _ in range(rng.randint(0, 30)))
        import pyarrow as pa

        from tidemark.llm.words import find_words

        w = words(text)
        runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {k for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        assert line_rules.repeated_words(find_words(pa.array([text])).hash) == len(hit)


def contamination_by_hand(text, items, window):
    cut = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER).encode())
    w, hit, met = cut(text), set(), set()
    for item, body in items:
        own = cut(body)
        size = min(window, len(own))
        runs = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(w) - size + 1):
            if size and tuple(w[i : i + size]) in runs:
                hit |= set(range(i, i + size))
                met.add(str(item))
    return len(w), len(hit), sorted(met), len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block", [10**6, 40])
def test_contamination_is_brute_force(spark, block):
    rng = random.Random(9)
    few = WORDS[:4]
    items = [(i, " ".join(rng.choice(few) for _ in range(rng.randint(1, 20)))) for i in range(12)] + [(50, None), (51, ""), (0, "ka ka, KA"), (None, "ka")]
    rows = []
    for i in range(60):
        parts = [rng.choice(few) if rng.random() < 0.9 else "öff" for _ in range(rng.randint(0, 40))]
        if i % 2:
            parts[3:3] = rng.choice(items[:12])[1].upper().split()
        rows.append((i, " ".join(parts), "a"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contamination(docs(spark, rows + EDGES), bench, window=6, words_per_block=block).collect()
    real = [(i, t) for i, t in items if i is not None]
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"], r.contaminated) for r in out)
    assert got == sorted((str(i), *contamination_by_hand(t, real, 6)) for i, t, _ in rows + EDGES)
    assert all(r.n_items == len(r["items"]) for r in out)


def test_decontaminated(spark):
    rng = random.Random(4)
    item = " ".join(f"q{i}" for i in range(60))
    rows = [(1, prose(rng, 40) + " " + item, "a"), (2, prose(rng, 1500) + " é, " + item + "! " + prose(rng, 9), "a"), (3, "clean text", "a"), (4, None, "a")]
    rows += [(6, prose(rng, 1400) + " " + item + ". " + prose(rng, 5), "a"), (7, "é" + prose(rng, 1600) + " " + item, "a")]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = {r.doc_id: r.text for r in decontaminate.decontaminated(docs(spark, rows).coalesce(1), bench).collect()}
    assert all(out[i] == t.replace(item, "") for i, t, _ in rows if i in (2, 6, 7))
    assert out.keys() == {2, 3, 4, 6, 7} and out[2] == rows[1][1].replace(item, "") and out[3] == "clean text" and out[4] is None
    assert decontaminate.decontaminated(docs(spark, rows), bench.limit(0)).count() == 6


def test_short_benchmark_spans_are_cut(spark):
    """Items of 20 to 40 words, a part of one and an item shorter than the window go from long documents, which stay."""
    rng = random.Random(14)
    items = [(n, " ".join(f"q{n}x{i}" for i in range(n))) for n in (5, 20, 30, 40)]
    part = " ".join(items[3][1].split()[10:24])
    rows = [(n, f"{prose(rng, 500)} é {t.upper()}. {prose(rng, 600)}", "a") for n, t in items]
    rows += [(1, f"{prose(rng, 600)} {part}, {prose(rng, 500)}", "a"), (2, prose(rng, 1100), "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = {r.doc_id: r for r in decontaminate.decontaminated(docs(spark, rows), bench).collect()}
    assert out.keys() == {5, 20, 30, 40, 1, 2}
    for i, text, _ in rows:
        assert out[i].text == text.replace(dict(items).get(i, part).upper() if i > 2 else part, "") and out[i].n_chars == len(out[i].text)
    left = decontaminate.contamination(spark.createDataFrame(list(out.values()), DOC), bench).agg(F.sum("n_hit")).first()[0]
    assert left == 0


def test_rule_ensemble(spark):
    rng, rows, labels = random.Random(6), [], []
    for i in range(400):
        bad = i % 5 == 0
        rows.append((i, prose(rng, 50).upper() + "!!" if bad else prose(rng, 50) + ".", "a"))
        labels.append((i, int(not bad), 0))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    table = docs(spark, rows + EDGES)
    model = rule_ensemble.train(table, known)
    assert 0 < len(model.rules) < 60
    out = rule_ensemble.quality(table, known).collect()
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id > 5]
    assert len(out) == 406 and sum(r.predicted == labels[r.doc_id][1] for r in held) >= 0.97 * len(held)
    assert rule_ensemble.quality(table, known.limit(0)).agg(F.min("predicted")).first()[0] == 1


def test_wrapper(spark):
    page = lambda k, body: f"<html><head><title>t</title></head><body><div class=top>Our site</div><div class=c><h1>Head {k}</h1>{body}</div><div>Use of this site</div></body></html>"
    rows = [(k, f"http://h.example/{k}", page(k, f"<p>Text {k} a&amp;b<br>more<p>{'long words ' * 9}{k}")) for k in range(6)]
    rows += [(10, None, None), (11, "http://x.example", ""), (12, "u", "<nav>menu</nav><article><h1>A</h1>x <b>y</b>\n z<form>f</form></article><footer>f</footer>"), (12, "u", "plain <i>text")]
    out = wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {(r.page_id, r.text) for r in out}
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    assert {(k, f"Head {k}\nText {k} a&b more\n{'long words ' * 9}{k}") for k in range(6)} <= text
    assert {(10, ""), (11, ""), (12, "A\nx y z"), (12, "plain text")} <= text
    assert wrapper.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrapper_drops_template_inside_the_article(spark):
    """Blocks that say the same on every page go, with a class or without, also where a tag marks the article."""
    page = lambda k, tag: f"<body><{tag}><h1>Head {k}</h1><p>Text {k} {'some words ' * 9}</p><p>Write to us.</p><div class=who><p>By the desk</p></div><div>Ask {k}</div></{tag}></body>"
    rows = [(k, f"http://{tag}.example/{k}", page(k, tag)) for tag in ("article", "main", "section") for k in range(6)]
    # an article tag that holds a teaser does not outweigh the slot that varies
    rows += [(k, "http://teaser.example", f"<body><article>See {k}</article><div class=c><p>{'own words ' * 20}{k}</p><ul><li>a {k}</li></ul></div></body>") for k in range(4)]
    for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        if "teaser" in r.url:
            assert r.text == f"{'own words ' * 20}{r.page_id}\na {r.page_id}"
        else:
            assert r.text == f"Head {r.page_id}\nText {r.page_id} {('some words ' * 9).strip()}\nAsk {r.page_id}"


def test_wrapper_counts_all_pages(spark):
    """Two layouts, blocks on part of the pages and many pages: what is template is decided over all of them."""
    own = lambda k: f"<h2>Head {k}</h2><p>Text {k} {'some words ' * 9}</p>"
    rows = []
    for k in range(60):
        body = f"<div class=c>{own(k)}{'<p>Write to us.</p>' if k % 4 else ''}</div><div class=low>Use of this site</div>"
        if k % 10 == 7:  # a rare layout with its parts in another order
            body = f"<div class=low>Use of this site</div><div class=x>Rare desk</div><div class=c><div class=by>By the rare desk</div>{own(k)}</div>"
        rows.append((k, f"http://h.example/{k}", f"<body><div class=top>Our site</div>{body}</body>"))
    # copies of one page say nothing about template
    rows += [(100 + k, f"http://copies.example/{k}", f"<body><article>{own(1)}</article></body>") for k in range(9)]
    for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        k = 1 if r.page_id >= 100 else r.page_id
        assert r.text == f"Head {k}\nText {k} {('some words ' * 9).strip()}", r.page_id


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(1, 60)), f"s{i % 5}" if i % 3 else "s0") for i in range(400)] + [(1000 + i, prose(rng, 5), None) for i in range(20)]
    table = docs(spark, rows + EDGES)
    out = mixing.mix(table).collect()
    assert len(out) == len(rows) + len(EDGES) and sorted(map(str, out)) == sorted(map(str, mixing.mix(table.repartition(7)).collect()))
    size, taken, target = Counter(), Counter(), {}
    for r in out:
        assert r.size == len(words(r.text)) and r.taken == r.copies * r.size <= 2 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    sources = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    left, open_, want = 1.5 * sum(size.values()), set(sources), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not over:
            break
        for s in over:
            want[s] = 2 * size[s]
            left -= want[s]
        open_ -= over
    want |= {s: level * weight[s] for s in open_}
    assert all(abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) <= 60 for s in sources)
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, EDGES[:3])).count() == 3


def test_stages_keep_columns_and_clean_rows(spark, tmp_path):
    rng = random.Random(12)
    rows = [(i, prose(rng, 40), f"s{i % 4}") for i in range(30)]
    rows += [(100, rows[3][1], "s1"), (101, rows[3][1] + " vaba", "s2"), (3, rows[3][1], "s3"), (102, None, "s1"), (None, prose(rng, 30), None)]
    table = docs(spark, rows)
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, rows[5][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    folder = str(tmp_path)
    assert stages.without_toxic(spark, table, folder).columns == table.columns
    assert stages.without_toxic(spark, table, folder).count() == len(rows)
    assert stages.without_repeated_lines(spark, table, folder).columns == table.columns
    one = stages.one_of_each(spark, table, folder)
    assert one.columns == table.columns and sorted(r.doc_id for r in one.collect() if r.doc_id is not None) == [*range(30), 102]
    assert sorted(r.doc_id for r in stages.without_benchmark(spark, one, folder).collect() if r.doc_id is not None) == [i for i in range(30) if i != 5] + [102]
    assert stages.mixed(spark, one, folder).where("copies < 1 or copies > 2").count() == 0


def test_parity_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(3)
    for size in (0, 1, 40, 3000):
        shared, a, b = (np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (size, size // 4 + 1, size // 5))
        x, y = np.union1d(shared, a), np.union1d(shared, b)
        bits = np.bitwise_count(jaccard.parity_sketch(x) ^ jaccard.parity_sketch(y)).sum()
        assert bits <= len(np.setxor1d(x, y))
        assert (jaccard.parity_sketch(x) == jaccard.parity_sketch(x[::-1])).all()


def test_hard_pages_are_read_in_linear_time(spark):
    """Deep trees, open tags, stray ends and many kinds: no page fails, and twice the page takes some twice the time."""
    made = {
        "deep": lambda n: "<body>" + "<div class=x>" * n + "<p>inner words" + "</div>" * n,
        "open": lambda n: "own words " + "<a " * n,
        "quotes": lambda n: "own words " + "<a \" <a ' " * n,
        "kinds": lambda n: "".join(f"<div class=c{i}>part {i}</div>" for i in range(n)),
        "stray": lambda n: "<div>" * n + "own words" + "</section>" * n,
    }
    rows = [(k, f"http://{name}.example", page(5000)) for k, (name, page) in enumerate(made.items())]
    rows += [(10 + k, "http://deep.example", f"<body>{'<div class=x>' * 3000}<p>Text {k} {'own words ' * 20}") for k in range(4)]
    out = {r.page_id: r.text for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[0] == "inner words" and out[1].startswith("own words <a <a") and out[2].startswith('own words <a "')
    assert out[3].count("part") == 5000 and out[4] == "own words"
    assert all(out[10 + k] == f"Text {k} {('own words ' * 20).strip()}" for k in range(4))
    for name, page in made.items():
        assert timed(lambda page=page: wrapper.extract(page(40_000), None)) < 6 * timed(lambda page=page: wrapper.extract(page(10_000), None)) + 2, name


def timed(work):
    start = time.process_time()
    work()
    return time.process_time() - start


def test_tree_matching_is_brute_force():
    """Heaviest pairing in order, next to all choices of rising places."""
    rng = random.Random(16)
    for _ in range(200):
        places = rng.sample(range(9), rng.randint(0, 9))
        weighed = [(p, rng.randint(1, 4)) for p in places]
        best = 0
        for chosen in range(1 << len(weighed)):
            taken = [w for k, w in enumerate(weighed) if chosen >> k & 1]
            if all(a[0] < b[0] for a, b in zip(taken, taken[1:])):
                best = max(best, sum(w for _, w in taken))
        total, which = wrapper._rising(weighed)
        assert total == best == sum(weighed[n][1] for n in which) and [weighed[n][0] for n in which] == sorted(weighed[n][0] for n in which)


INNER = "_id _hit _gone _left _said _stays _n_gone _n _spans _items _cut _own_items _own_n_hit _u _rank _bin _seed _sure _rest _last _moment _source _line _key said at key".split()


@pytest.mark.parametrize("extra", [INNER, [f"own {k}" for k in range(9)][::-1], ["n_lines", "N_Removed", "items", "n_hit", "size", "taken", "a.b", "c`d"]])
def test_columns_named_like_inner_ones(spark, extra):
    """Columns of the input stay as they are, or are replaced where the docstring says so, and change no result."""
    rng = random.Random(17)
    item = prose(rng, 20)
    rows = [(i, f"own line {i} {prose(rng, 20)}\nAll rights reserved now.\n{prose(rng, 500)} {item if i % 3 else ''}", f"s{i % 4}") for i in range(20)]
    plain = docs(spark, rows + EDGES)
    wide = plain.select("*", *(F.lit(f"own {c}").alias(c) for c in extra))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for work in (line_dedup.dedup_lines, mixing.mix, lambda d: decontaminate.contamination(d, bench), lambda d: decontaminate.decontaminated(d, bench)):
        named = lambda r, columns: tuple(str(r[c]) for c in columns)
        expected, found = work(plain), work(wide)
        assert sorted(named(r, expected.columns) for r in found.collect()) == sorted(named(r, expected.columns) for r in expected.collect())
        for c in set(extra) & set(found.columns) - set(expected.columns):
            assert {r[c] for r in found.collect()} == {f"own {c}"}


def test_line_dedup_of_many_lines(spark):
    """A document of many thousand lines, a third of them boilerplate, and rows that repeat an id with other texts."""
    lines = [f"line number {i} of many" for i in range(30_000)]
    shared = [t for i, t in enumerate(lines) if i % 3 == 0]
    rows = [(k, "\n".join(shared), f"s{k}") for k in range(3)] + [(7, "\n".join(lines), "s7"), (7, "some own line here\n" + shared[5], "s7"), (7, None, "s7")]
    out = line_dedup.dedup_lines(docs(spark, rows)).collect()
    texts = {r.text: r.n_removed for r in out if r.doc_id == 7}
    assert texts == {"\n".join(t for i, t in enumerate(lines) if i % 3): 10_000, "some own line here": 1, None: 0}


def test_stages_bound_batches_by_bytes(spark, tmp_path):
    """A batch of pairs of long texts does not reach a worker whole; a session's own bound stays."""
    import pyarrow as pa

    from tidemark.llm import frames

    own = spark.conf.get(frames.BATCH, None)
    spark.conf.unset(frames.BATCH)
    try:
        docs = spark.createDataFrame([(k, f"{k} some words of a text", "en", "a", 0) for k in range(3)], "doc_id long, text string, lang string, source string, n_chars long")
        assert stages.one_of_each(spark, docs, str(tmp_path)).count() == 3
        sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
        texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("a"), 10_000).alias("text"))
        assert max(r.n for r in texts.mapInArrow(sizes, "n long").collect()) < 9 << 20
        spark.conf.set(frames.BATCH, "1m")
        frames.bounded_batches(spark)
        assert spark.conf.get(frames.BATCH) == "1m"
    finally:
        spark.conf.unset(frames.BATCH) if own is None else spark.conf.set(frames.BATCH, own)
