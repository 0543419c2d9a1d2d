"""Turn layouts by fingerprint, names against articles, broken tags, and a brute-force count of subtrees."""

import collections
import random
import xml.etree.ElementTree as ET

import pytest


def test_a_turns_fingerprint_chooses_its_mapping(spark):
    from skein.llm import chat

    def turns(rows):
        return {r.conv_id: [tuple(t) for t in r.turns] for r in chat.turns_of_rows(rows).collect()}

    said = [(1, 0, "user", "a"), (1, 1, None, None), (2, 0, "assistant", "b")]
    want = {1: [("user", "a"), ("", "")], 2: [("assistant", "b")]}
    assert turns(spark.createDataFrame(said, "conv_id long, turn long, role string, text string")) == want
    assert turns(spark.createDataFrame(said, "conv_id long, turn long, role string, content string")) == want
    more = [(*r, "me", 1.5, ["t"], ("x",)) for r in said]  # fields that no layout uses
    assert turns(
        spark.createDataFrame(more,
            "conv_id long, turn long, role string, text string, author string, weight double, tags array<string>, seen struct<by string>")) == want
    told = [(1, 0, "human", "a"), (1, 1, "gpt", "b"), (1, 2, "tool", None)]
    assert turns(spark.createDataFrame(told, "conv_id long, turn long, `from` string, value string")) == {
        1: [("user", "a"), ("assistant", "b"), ("tool", "")]}
    assert turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")) == {}
    with pytest.raises(ValueError, match="no mapping"):
        chat.turns_of_rows(spark.createDataFrame(said, "conv_id long, turn long, who string, text string"))
    both = spark.createDataFrame([(1, 0, "user", "a", "b")], "conv_id long, turn long, role string, text string, content string")
    with pytest.raises(Exception, match="no mapping"):
        turns(both)


@pytest.mark.parametrize(
    "page, want",
    [
        ("<form><nav>menu</nav><article><p>Main text.</p></article></form>", "Main text."),
        ('<article class="post related-topic"><p>Main text of the page.</p></article><div>foot</div>', "Main text of the page."),
        ('<div class="layout with-sidebar"><p>Main text, the longer part.</p><div class="sidebar">side</div></div>',
            "Main text, the longer part."),
        ('<div id="social-page"><p>Main text.</p></div>', "Main text."),
        ('<p class="x>one</p><p title=it\'s>two</p><p id=\'y>three</p><p class="z">four</p>', "one two three four"),
        ("<article><p>Main text of the page.</p></article><article class=teaser><p>read on</p></article>", "Main text of the page."),
        ("<article><div class=share-body><p>Main text of the page.</p></div><div class=related>more</div></article>",
            "Main text of the page."),
        ("<article><p>Main.</p><div class=comments><p>a very long comment of a reader, longer than all</p></div></article>", "Main."),
        ("<div>words of the body, enough of them</div><form>search</form><div class=comments><article class=comment>hello</article></div>",
            "words of the body, enough of them"),
        ("<form><p>All is in here.</p><input value=x></form>", "All is in here."),
        ('<p data-x="<b>bold</b>" class="y">text</p>', "text"),
        ("", ""), ("<p>", ""), ("<<<>>>", "<<<>>>"), ("<div class=sidebar>only this</div>", "only this"),
    ],
)
def test_names_are_weak_reasons(page, want):
    from skein.llm.page_text import Page

    assert Page(page).text() == want and Page(f"<html><body>{page}</body></html>").text() == want


def test_templates_are_counted_like_a_plain_count(spark):
    """Recurrence alone, over generated pages, against a tree walk that counts serialized subtrees per host."""
    from skein.llm.page_text import LEAST_PAGES, NEARLY_ALL, extract_text

    rng = random.Random(4)
    shared = ["<div class='m'><p>menu one</p><p>menu two</p></div>", "<ul><li>legal</li></ul>",
        "<section><div><p>rare</p></div></section>", "<p>short line</p>"]

    def page(i):
        own = [f"<div class='c'><p>story {i} {rng.random()}</p><p>{'words ' * rng.randrange(20, 40)}{i}</p></div>"]
        parts = own + [s for n, s in enumerate(shared) if rng.random() < (0.9, 0.6, 0.15, 0.4)[n]]
        rng.shuffle(parts)
        return f"<html><body>{''.join(parts)}</body></html>"

    pages = [(i, f"http://{'ab'[i % 2]}.example/{i}", page(i)) for i in range(40)]
    pages += [(100 + i, "http://a.example/copy", pages[0][2]) for i in range(9)] + [(200 + i, None, p) for i,
        (_, _, p) in enumerate(pages[:8])] + [(300, "http://a.example/", None), (301, "http://a.example/", "")]

    def walk(node):
        """Serialized subtrees that hold text, with their blocks."""
        own = [node.text.strip()] if (node.text or "").strip() else []
        found = []
        for child in node:
            texts, below = walk(child)
            own += texts
            found += below
        return own, [*found, (ET.tostring(node, encoding="unicode"), own)] if own else found

    seen, trees = collections.defaultdict(set), {}
    for i, url, source in pages:
        if source:
            trees[i] = walk(ET.fromstring(source))
            for serial, own in trees[i][1]:
                if url and sum(len(t) + 1 for t in own) < NEARLY_ALL * sum(len(t) + 1 for t in trees[i][0]):
                    seen[url[7], serial].add(source)
    want = {}
    for i, url, source in pages:
        if not source:
            want[i] = ""
            continue
        gone = [own for serial, own in trees[i][1] if url and len(seen[url[7], serial]) >= LEAST_PAGES]
        left = collections.Counter(trees[i][0]) - collections.Counter({t for own in gone for t in own})
        kept = [t for t in trees[i][0] if left[t]]
        want[i] = " ".join(" ".join(kept).split())
    got = extract_text(spark.createDataFrame(pages, "page_id long, url string, html string"), hints=False).collect()
    assert {r.page_id: r.text for r in got} == want
    assert any("menu one" not in want[i] for i, u, _ in pages if u) and all("menu one" in want[i] for i in range(200, 208)
        if "menu one" in pages[i - 200][2])
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_vocabularies_that_need_whole_texts(spark, tmp_path):
    """Another vocabulary's ids are those of whole texts; only the known kind is cut."""
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from skein.llm import token_files

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_files.splits_at_blanks(public_tokenizers.path("word_bpe_49k.json")) and not token_files.splits_at_blanks(path)
    texts = {1: "Hello  world,\n\n  twice  ", 2: None, 3: "x" * 5000 + "  ", 4: " a  b"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in token_files.read_token_file(*token_files.write_token_file(docs, tokenizer=path)).collect()}
    whole = Tokenizer.from_file(path)
    for i, t in texts.items():
        ids = whole.encode(t or "", add_special_tokens=False).ids + [token_files.END_ID]
        assert (got[i].n_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_language_scores_against_a_plain_coder():
    """Code lengths against a byte-by-byte coder over dictionaries; the score says how sure a stretch of 16 bytes is."""
    import math

    import pyarrow as pa

    from skein.llm.kernels import text_bytes
    from skein.llm.language import ORDER, SCORED_BYTES, ContextTrees

    samples = {"aa": ["the cat sat on the mat", "then the hat", "é à"], "bb": ["der Hut und die Katze", "das ist der Satz"], "cc": ["x"]}
    asked = ["the hat sat", "die Katze", "then der", "zzzz", "é", "x" * 40, "the mat and the hat " * 9]
    trees = ContextTrees(samples)

    def counts(texts):
        seen: dict[bytes, collections.Counter] = collections.defaultdict(collections.Counter)
        for t in texts:
            data = b"\0" * ORDER + t.encode()
            for i in range(ORDER, len(data)):
                for k in range(ORDER + 1):
                    seen[data[i - k : i]][data[i]] += 1
        return seen

    def bits(seen, text):
        data, total = b"\0" * ORDER + text.encode(), 0.0
        for i in range(ORDER, len(data)):
            for k in range(ORDER, -1, -1):
                here = seen.get(data[i - k : i])
                if not here:
                    continue
                n, d = sum(here.values()), len(here)
                if data[i] in here:
                    total -= math.log2(here[data[i]] / (n + d))
                    break
                total += math.log2((n + d) / d)
            else:
                total += 8
        return total

    raw, offsets = text_bytes(pa.array(asked))
    got = trees.code_lengths(raw, offsets)
    for i, text in enumerate(asked):
        want = [bits(counts(samples[name]), text) for name in trees.languages]
        assert all(abs(a - b) < 1e-3 * max(1, b) for a, b in zip(got[i], want, strict=True)), text
        share = min(1.0, SCORED_BYTES / len(text.encode()))
        best = min(want)
        label, score = trees.predict(pa.array([text]))
        assert abs(score[0] - 1 / sum(2 ** ((best - w) * share) for w in want)) < 1e-4 and label[0] == trees.languages[want.index(best)]
