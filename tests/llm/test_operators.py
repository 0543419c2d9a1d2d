"""The ten operators against brute force, exact round trips or held-out accuracy, and on odd rows."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return {i: t for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()}


def ask(spark, name):
    import __spark_entry__

    return {r[0]: r for r in __spark_entry__.queries()[name](spark, FOLDER).collect()}


def odd(spark):
    """Null, empty, blank, repeated and very long texts, with a column that clashes with results."""
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "one two three four five six"), (4, "one two three four five six"),
        (None, "déjà vu <s>[INST] ~1"), (6, "long word " * 60_000), (7, "x")]
    return spark.createDataFrame([(i, t, "en" if t else None, None, "z") for i, t in texts],
        "doc_id long, text string, lang string, source string, score string")


def test_tokens_are_those_of_whole_texts(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, got, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), ask(spark, "op1_token_file"), 0
    for i in sorted(docs):
        ids = tokenizer.encode(docs[i] or "", add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_language_is_right_on_held_out_texts(spark):
    langs = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{FOLDER}/documents.parquet'").fetchall())
    held = [(langs[i], r.lang_pred) for i, r in ask(spark, "op2_language_id").items() if r.held_out and langs[i]]
    assert len(held) > 40 and sum(a == b for a, b in held) >= 0.97 * len(held)


def test_leaks_are_the_contained_items(spark, docs):
    from skein.llm import contamination

    items = dict(duckdb.sql(f"SELECT item_id, text FROM '{FOLDER}/benchmark.parquet'").fetchall())
    flat = lambda s: " ".join((s or "").lower().split())
    planted = dict(docs) | {9001: "Start. " + items[3].replace("the", "thee", 2) + " End.", 9002: "nothing of the kind is said here"}
    df = spark.createDataFrame(list(planted.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contamination.find_leaks(df,
            spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    want = {(i, k) for i, t in planted.items() for k, x in items.items() if len(flat(x)) >= 24 and flat(x) in flat(t)}
    assert want <= got and (9001, 3) in got and not any(i == 9002 for i, _ in got)


def test_near_copies_share_a_class(spark):
    from skein.llm.near_dups import near_duplicates

    random.seed(5)
    base = [" ".join(random.choice("abcdefghij") + str(random.randrange(300)) for _ in range(80)) for _ in range(60)]
    rows = list(enumerate(base))
    for i in range(30):  # a few words changed, or an exact copy
        words = base[i].split()
        for at in random.sample(range(80), i % 3):
            words[at] = "new"
        rows.append((100 + i, " ".join(words)))
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[100 + i] == i for i in range(30)) and all(got[i] == i for i in range(60))


def test_components_against_union_find(spark, tmp_path):
    from skein.llm.graph import components
    from skein.llm.storage import Stage

    random.seed(2)
    links = [(random.randrange(80), random.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 230)]
    parent = {x: x for link in links for x in link if link[0] != link[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    df = lambda x: spark.createDataFrame(x, "a long, b long")
    stage = Stage(spark, "test")
    half = components(df(links[:40]), stage, "one")
    for found in (components(df(links), stage, "all"), components(df(links[40:]), stage, "two", half)):
        assert {r.node: r.root for r in found.collect()} == {x: root(x) for x in parent}


def test_mixture_equals_its_sql(spark):
    from skein.llm import mixture

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = collections.Counter(con.execute(f"SELECT doc_id, copy FROM ({mixture.mixture_sql()})").fetchall())
    assert collections.Counter((r.doc_id, r.copy) for r in mixture.op3_source_mixture(spark, FOLDER).collect()) == want


def test_language_model_base_score(spark, docs):
    word = re.compile(rb"[^\x20\x09-\x0D]+")
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens = {i: [*word.findall((t or "").encode().translate(low)), None] for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    counts = collections.Counter(w for i, x in tokens.items() if not held[i] for w in x)
    n, v = sum(counts.values()), len(counts)
    ours = floor = 0.0
    for i, r in ask(spark, "op5_lm_score").items():
        logs = [np.log10((counts[w] + 1) / (n * 1.0 + v + 1)) for w in tokens[i]]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens[i]), sum(w in counts for w in tokens[i]), n)
        assert abs(r.base_score - sum(logs)) < 1e-6 * max(1, abs(sum(logs)))
        if held[i]:
            ours, floor = ours + r.score, floor + r.base_score
    assert ours > floor


def test_media_round_trip(spark, docs):
    for i, r in ask(spark, "op6_media_pages").items():
        data = (docs[i] or "").encode()
        payload = data.ljust(max(1, -(-len(data) // 576)) * 576, b"\xff")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload),
            hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_lzw_and_broken_media():
    from skein.llm.media import pack_bits, pages_of, unpack_bits, unpack_lzw, write_tiff

    # the worked example of the TIFF specification: 7 7 7 8 8 7 7 6 6
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes).ljust(88, "0")
    assert unpack_lzw(int(bits, 2).to_bytes(11, "big"), 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    data = random.Random(1).randbytes(576 * 200)
    assert unpack_bits(pack_bits(data), len(data)) == data
    assert b"".join(p["pixels"] for p in pages_of(write_tiff(data))) == data
    with pytest.raises(ValueError):
        list(pages_of(b"no tiff"))


def test_chat_reads_back(spark):
    from skein.llm import chat

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{FOLDER}/conversations.parquet'")
    want = {r[0]: r[1:]
        for r in con.execute(f"SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars FROM ({chat.CHAT_SQL})").fetchall()}
    assert {i: tuple(r)[1:] for i, r in ask(spark, "op7_chat_format").items()} == want
    rows = spark.createDataFrame([('{"instruction": "do", "input": "x", "output": "y"}',),
            ('{"conversations": [{"from": "human", "value": "a"}]}',), ('{"other": 1}',), (None,)], "record string")
    turns = [r.turns and [tuple(t) for t in r.turns] for r in chat.canonical_turns(rows).collect()]
    assert turns == [[("user", "do\n\nx"), ("assistant", "y")], [("user", "a")], None, None]


def test_base_secrets(spark, docs):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.IGNORECASE | re.ASCII)
    for i, r in ask(spark, "op8_secret_scan").items():
        text, found = docs[i] or "", []
        for kind, (name, pattern, group, least) in enumerate(
            (("assign", assign, 2, 8), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32))):
            found += [(m.start(), kind, f"{name}:{m.start()}:{m.end()}") for m in pattern.finditer(text) if len(m.group(group)) >= least]
        told = [x[2] for x in sorted(found)]
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest() and set(told) <= set(r.spans.split(",")) | {""}


def test_base_secrets_are_counted_by_kind(spark, tmp_path):
    """Rows with none, one, several and mixed kinds, copied ids, signs beyond 16 bits, letters that only look like those of the patterns."""
    from skein.llm import secret_scan

    access, digits = "AKIA" + "B2" * 6, "0a" * 16
    texts = [(None, "token=abcdefgh", (1, 0, 0)), (0, None, (0, 0, 0)), (1, "", (0, 0, 0)), (2, f"{access} {access}", (0, 2, 0)),
        (2, f"{access} {access}", (0, 2, 0)), (3, digits, (0, 0, 1)), (4, f"{digits} {access} token={digits}", (1, 1, 2)),
        (5, "Secret : 'ABCDEFGH password=1234567 api_KEY==abcdefg", (2, 0, 0)), (6, "\U0001f600 \u017fecret=abcdefgh to\u212aen=abcdefgh",
            (0, 0, 0)), (7, f"{access[:15]} {digits[1:]}", (0, 0, 0)), (8, "token=" * 1000, (1, 0, 0)), (9, f"passwd={access} " * 500, (500, 500, 0))]
    spark.createDataFrame([x[:2] for x in texts], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_id, (r.n_assign, r.n_access, r.n_hex)) for r in secret_scan.op8_secret_scan(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([(i, n) for i, _, n in texts], key=str)


def test_random_strings_are_told_from_words(spark):
    from skein.llm import secret_scan

    rng = random.Random(3)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(300)]
    names = [("internationalization" * 2 + str(i)) for i in range(60)]
    rows = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(keys + names)], "doc_id long, text string")
    found = {r.doc_id for r in secret_scan.found_secrets(secret_scan.scan(rows)).collect() if r.spans}
    assert len([i for i in found if i < 300]) >= 200 and len([i for i in found if i >= 300]) == 0


def test_page_text(spark):
    from skein.llm.page_text import extract_text

    page = "<html><body><nav>Menu</nav><div class='ad'>Buy</div><article><h1>T&amp;x</h1><p>One\n two<br>three</p></article><footer>F</footer><script>var a='</p>'</script></body></html>"
    rows = spark.createDataFrame([(1, "http://a/x", page), (2, None, None), (3, "bad", ""), (3, "bad", "")],
        "page_id long, url string, html string")
    assert sorted((r.page_id, r.text) for r in extract_text(rows).collect()) == [(1, "T&x One two three"), (2, ""), (3, ""), (3, "")]


def test_odd_rows(spark):
    from skein.llm import contamination, language, lm_score, media, mixture, near_dups, secret_scan, token_files

    for rows in (odd(spark), odd(spark).limit(0)):
        n = rows.count()
        assert token_files.read_token_file(*token_files.write_token_file(rows)).count() == n
        trees = language.ContextTrees(language.training_sample(rows))
        assert language.predict_language(rows, trees).count() == n
        assert near_dups.near_duplicates(rows).count() == n
        assert lm_score.score_texts(rows, rows).count() == n
        assert media.page_digests(media.tiff_pages(media.text_media(rows))).count() == n
        assert secret_scan.found_secrets(secret_scan.scan(rows)).count() == n
        assert contamination.without_leaks(rows, rows.limit(0).select("doc_id", "text").toDF("item_id", "text")).count() == n
        mixture.mix_sources(rows).count()


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
        assert docs.count() > 100
    assert step is not None and corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == docs.count()


def test_language_model_keeps_rare_pairs(spark, monkeypatch):
    """Every pair counts, however rare, at every size of corpus and number of parts."""
    from skein.llm import lm_score

    monkeypatch.setattr(lm_score, "PART_BYTES", 2_000_000)
    # with 3 million tokens of filler a share of 1e-6 is more than two occurrences
    rare = [f"r{i} s{i} t{i}" for i in range(50)]
    texts = [*rare, *(" ".join(["filler"] * 300_000) for _ in range(10))]
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    asked = [*rare, *(f"s{i} r{i} t{i}" for i in range(50))]
    got = {r.text_id: r for r in lm_score.score_texts(spark.createDataFrame(list(enumerate(asked)), "text_id long, text string"),
            train).collect()}
    tokens = [[*t.split(), None] for t in texts]
    one = collections.Counter(w for x in tokens for w in x)
    two = collections.Counter(p for x in tokens for p in zip(x, x[1:]))
    n, v = sum(one.values()), len(one)
    for i, text in enumerate(asked):
        words = [*text.split(), None]
        want = np.log10((one[words[0]] + 1) / (n + v + 1))
        for a, b in zip(words, words[1:]):
            want += np.log10((two[a, b] + lm_score.PRIOR * (one[b] + 1) / (n + v + 1)) / (one[a] + lm_score.PRIOR))
        assert abs(got[i].score - want) < 1e-9 * abs(want), text
    assert min(got[i].score for i in range(50)) > max(got[i].score for i in range(50, 100))


def test_page_templates_inside_articles(spark):
    """A block that recurs inside articles goes, on however small a share of the host's pages."""
    from skein.llm.page_text import extract_text

    page = lambda i: f"<html><body><article><p>Story {i} tells of {i * 7} things and then of some more.</p>{'<div class=zz><p>Tell a friend</p></div>' if i < 6 else ''}</article></body></html>"
    rows = spark.createDataFrame([(i, f"http://a/{i}", page(i)) for i in range(100)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_text(rows).collect()}
    assert got == {i: f"Story {i} tells of {i * 7} things and then of some more." for i in range(100)}


def test_copied_pages_are_no_template(spark):
    """Copies of a page count once, and a subtree with an article or nearly all text stays."""
    from skein.llm.page_text import extract_text

    one = "<html><body><div class='wrap'><article><p>Copied story</p><p>second part</p></article></div></body></html>"
    two = "<html><body><div class='content'><p>No article here</p></div></body></html>"
    pages = [(i, f"http://a/{i}", one) for i in range(8)] + [(10 + i, f"http://a/x{i}", two) for i in range(8)]
    pages += [
        (20 + i, f"http://b/{i}", f"<html><body><div class='w'><div><article><p>Same words</p></article></div></div><p>{i}</p></body></html>")
        for i in range(8)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: "Copied story second part" if i < 10 else "No article here" if i < 20 else "Same words" for i, _, _ in pages}


def test_copied_strings_count_once_for_the_cut(spark):
    """Neither a copied secret nor a copied word of high p-value moves the cut of its stratum."""
    from skein.llm import secret_scan

    rng = random.Random(4)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    bin_of = lambda t: secret_scan.candidates(t, [])[0][3]
    keys = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(1000)]
    copied = next(k for k in keys if bin_of(k) == 30)
    names = [f"internationalization{w}Handler{w}Factory"[:40] for w in ("Account", "Session", "Request", "Element", "Product")]

    def found(copies):
        rows = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(keys + names + copies)], "doc_id long, text string")
        return {r.doc_id for r in secret_scan.found_secrets(secret_scan.scan(rows)).collect() if r.spans}

    alone, more = found([]), found([copied] * 3000)
    assert {i for i in more if i < 1005} == alone and len([i for i in alone if i < 1000]) >= 900
    assert all(i in more for i in range(1005, 4005))


def test_chat_keeps_very_long_turns(spark):
    """A turn beyond the limits of a JSON parser is formatted, and a record that can't be parsed is an error."""
    from pyspark.sql import functions as F

    from skein.llm import chat

    rows = spark.range(1).select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"),
        F.repeat(F.lit("x"), F.lit(21_000_000)).alias("text"))
    row = chat.format_chat(chat.turns_of_rows(rows)).select(F.length("formatted"), F.to_json("loss")).first()
    assert tuple(row) == (21_000_000 + 22, '[{"begin":18,"end":21000018}]')
    with pytest.raises(Exception, match="(?i)json"):
        chat.canonical_turns(spark.createDataFrame([('{"prompt": "cut off',)], "record string")).collect()


def test_language_sample_counts_different_texts(spark):
    """A label of many rows and few different texts is learned from all of them."""
    from skein.llm import language

    rows = spark.range(200_000).selectExpr("concat('text ', id % 300) AS text", "'xx' AS lang")
    assert len(language.training_sample(rows)["xx"]) == 300


def test_tokens_of_every_letter_before_a_stop():
    """Pieces give the ids of the whole text, whatever letter stands before a full stop or comma."""
    import sys

    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from skein.llm.kernels import text_bytes
    from skein.llm.token_files import WordIds

    path = public_tokenizers.path("word_bpe_49k.json")
    letters = [chr(i) for i in range(sys.maxunicode + 1) if chr(i).isalpha()]
    texts = [" ".join(f"x{c}{stop} {c}{stop}" for c in letters[i : i + 500]) for i in range(0, len(letters), 500) for stop in ".,"]
    texts += ["\u0130. \ufb1d, e\u0301. a\u0338. a \u0301. x\u00a0y. \u1e9e. 12. a.. .", "O'Neill's. d'\u00e9t\u00e9."]
    raw, offsets = text_bytes(pa.array(texts))
    ids, counts = WordIds(path).encode(raw, offsets)
    whole = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    ends = np.cumsum(counts)
    for text, want, a, b in zip(texts, whole, ends - counts, ends, strict=True):
        assert ids[a:b].tolist() == want.ids, text[:40]


def test_language_of_numerals_is_unknown_and_the_sample_is_bounded(spark):
    """Numerals that aren't letters make no language; all labels together keep to the bound of characters."""
    import pyarrow as pa

    from skein.llm import language

    trees = language.ContextTrees({"aa": ["one half and more"], "bb": ["das ist ein Satz"]})
    labels, score = trees.predict(pa.array(["\u00bd \u00b2 \u2163", "12 \u00bd x", None, ""]))
    assert labels[0] == labels[2] == labels[3] == "und" and labels[1] != "und" and score[0] == 0
    rows = spark.range(400).selectExpr("concat(repeat('text ', 100), id) AS text", "if(id % 2 = 0, 'xx', 'yy') AS lang")
    sample = language.training_sample(rows, characters=20_000)
    assert set(sample) == {"xx", "yy"} and all(15 <= len(x) < 20 for x in sample.values())


def test_mixture_targets_that_do_not_occur(spark):
    """Targets of which none occurs give no rows; null may be named; rates meet the targets."""
    from skein.llm import mixture

    rows = spark.range(900).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 3 = 1 THEN 'b' END AS source")
    assert mixture.mix_sources(rows, targets={"zz": 1.0}).count() == 0
    got = {r.source: r["count"] for r in mixture.mix_sources(rows, targets={None: 3.0, "a": 1.0},
            total=4000).groupBy("source").count().collect()}
    assert set(got) == {None, "a"} and abs(got[None] - 3000) < 250 and abs(got["a"] - 1000) < 150


def test_chat_layouts_with_more_fields_or_no_messages(spark):
    """A field that no layout uses doesn't change the layout; no messages are no turns; an unknown nesting stays unknown."""
    from skein.llm import chat

    records = [
        '{"messages": [{"role": "user", "content": "a", "name": "bob", "weight": 1.5}], "id": 7}',
        '{"messages": []}', '{"conversations": [], "source": "x"}', '{"id": 1, "prompt": "p", "completion": "c", "tags": ["t"]}',
        '{"messages": [{"role": "user", "content": {"parts": "a"}}]}', '{"conversations": [{"from": "gpt", "value": "v", "my key": null}]}',
    ]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "i int, record string")
    got = {r.i: r.turns if r.turns is None else [tuple(t) for t in r.turns] for r in chat.canonical_turns(rows).collect()}
    assert got == {0: [("user", "a")], 1: [], 2: [], 3: [("user", "p"), ("assistant", "c")], 4: None, 5: [("assistant", "v")]}


def test_chat_of_many_turns(spark):
    """The loss mask of a conversation of very many turns, against a plain loop; rows with odd values and clashing names."""
    from pyspark.sql import functions as F

    from skein.llm import chat

    for n in (0, 1, 255, 256, 257, 30_000):
        rows = spark.range(n).selectExpr("1 AS conv_id", "id AS turn", "if(id % 3 = 0, 'user', 'assistant') AS role",
            "concat('t~<', id) AS text")
        made = chat.format_chat(chat.turns_of_rows(rows)).collect()
        assert len(made) == min(n, 1)
        if made:
            want = [f"t~<{i}" for i in range(n) if i % 3]
            assert [made[0].formatted[r.begin : r.end].replace("~1", "<").replace("~0", "~") for r in made[0].loss] == want
    odd_rows = spark.createDataFrame([(None, None, None, None), (1, 0, "assistant", ""), (1, 0, "assistant", ""), (1, None, None, "x")],
        "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_chat(chat.turns_of_rows(odd_rows)).withColumn("back",
            chat.read_chat(F.col("formatted"))).collect()}
    assert [tuple(t) for t in got[1].back] == [("", "x"), ("assistant", ""), ("assistant", "")] and len(got[1].loss) == 2
    assert [tuple(t) for t in got[None].back] == [("", "")]


def _tiff(entries, data, order="<"):
    """A file of one directory with these (tag, type, count, value) entries and image data from byte 8 on."""
    import struct

    at = 8 + len(data) + len(data) % 2
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", at) + data + b"\0" * (len(data) % 2)
    body = struct.pack(order + "H", len(entries))
    for tag, kind, count, value in sorted(entries):
        body += struct.pack(order + "HHI", tag, kind, count) + (struct.pack(order + "HH", value, 0) if kind == 3
            else struct.pack(order + "I", value))
    return head + body + b"\0\0\0\0"


def test_media_layouts_and_unreadable_media(spark):
    """LZW both ways; 16 bits with predictor, planes apart, one bit; broken files are marked and stop nothing."""
    import struct

    from skein.llm import media

    rng = random.Random(8)
    for n in (0, 1, 2, 5_000, 300_000):
        for data in (bytes(rng.randrange(3) for _ in range(n)), rng.randbytes(n)):
            assert media.unpack_lzw(media.pack_lzw(data), n) == data
    long = rng.randbytes(576 * 64 * 5)
    assert b"".join(p["pixels"] for p in media.pages_of(media.write_tiff(long))) == long
    base = lambda w, h, bits, samples, n: [(256, 3, 1, w), (257, 3, 1, h), (258, 3, 1, bits), (277, 3, 1, samples), (273, 4, 1, 8),
        (279, 4, 1, n), (278, 3, 1, h)]
    wide = [rng.randrange(65536) for _ in range(12)]
    steps = [(v - (wide[i - 1] if i % 4 else 0)) % 65536 for i, v in enumerate(wide)]
    for order in "<>":
        file = _tiff([*base(4, 3, 16, 1, 24), (317, 3, 1, 2)], struct.pack(f"{order}12H", *steps), order)
        assert struct.unpack(f"{order}12H", next(media.pages_of(file))["pixels"]) == tuple(wide)
    assert next(media.pages_of(_tiff(base(9, 2, 1, 1, 4), b"\xaa\x80\x55\0")))["pixels"] == b"\xaa\x80\x55\0"
    good = media.write_tiff(b"x" * 576)
    zero = _tiff([*base(4, 3, 8, 0, 12), (284, 3, 1, 2)], b"a" * 12)
    files = [(1, good), (2, zero), (3, good[: len(good) // 2]), (4, b"no tiff"), (5, None), (6, b""), (7, good)]
    rows = spark.createDataFrame([(i, 576, f) for i, f in files], "doc_id long, n_bytes long, media binary").coalesce(1)
    got = {r.doc_id: r for r in media.page_digests(media.tiff_pages(rows)).collect()}
    assert set(got) == {1, 2, 3, 4, 6, 7} and all((got[i].error is None) == (i in (1, 7)) for i in got)
    assert all(got[i].payload_sha256 is None for i in (2, 3, 4, 6)) and got[1].payload_bytes == 576


def _similar(a, b):
    """The definition: shingle sets of five words, and a plain edit distance of words."""
    x, y = a.lower().split(), b.lower().split()
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()} for w in (x, y)]
    if not sets[0] and not sets[1]:
        return True
    if 2 * len(sets[0] & sets[1]) < 0.8 * (len(sets[0]) + len(sets[1])) - 1e-9:
        return False
    row = list(range(len(y) + 1))
    for i, w in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, v in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (w != v))
    return row[-1] <= 0.2 * max(len(x), len(y)) + 1e-9


def _classes(texts):
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if root(i) != root(j) and _similar(texts[i], texts[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def test_near_duplicates_against_all_pairs(spark):
    """Classes of texts of all lengths, with edits up to the edge of the threshold, are those of all pairs."""
    from skein.llm.near_dups import near_duplicates

    rng = random.Random(11)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(200))
    texts = ["", " \n", "One", "one", "one two", "a b c d e f g h", "a b c d e f g h i", "A b c d e f g h"]
    for size in (8, 9, 10, 12, 14, 17, 20, 25, 40, 80, 200):
        for _ in range(12):
            own = [word() for _ in range(size)]
            texts.append(" ".join(own))
            for n in sorted({1, max(1, size // 45), max(1, size // 27)}):
                other = list(own)
                for at in rng.sample(range(size), n):
                    other[at] = word()
                texts.append(" ".join(other))
            texts.append(" ".join([*own, *(word() for _ in range(max(1, size // 5)))]))
            texts.append(" ".join(own[1:]))
    want = _classes(texts)
    got = {r.doc_id: r.class_id for r in near_duplicates(
            spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    linked = [i for i in range(len(texts)) if want[i] != i]
    assert len(linked) > 300 and all(got[i] == i for i in range(len(texts)) if want[i] == i)
    assert sum(got[i] == want[i] for i in linked) >= 0.98 * len(linked)


def test_near_duplicates_of_a_table_against_all_pairs(spark, docs):
    """The whole test table: the classes of all pairs, but for a stray pair at the edge; none merged that should stand apart."""
    from skein.llm.near_dups import near_duplicates

    ids = sorted(docs)
    want = {i: ids[c] for i, c in zip(ids, _classes([docs[i] or "" for i in ids]), strict=True)}
    rows = spark.createDataFrame([(i, docs[i]) for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_duplicates(rows).collect()}
    assert len(got) == len(ids) and all(want[got[i]] == want[i] for i in ids)
    assert sum(got[i] != want[i] for i in ids) <= 0.02 * sum(want[i] != i for i in ids) + 1


def test_planted_secrets_in_a_table(spark, docs):
    """Random strings planted in the test table are found, ordinary runs and clean documents stay as they are."""
    from skein.llm import secret_scan

    rng = random.Random(21)
    alphabets = ["0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    planted = dict(docs)
    for i in range(40):
        key = "".join(rng.choice(alphabets[i % 4]) for _ in range(rng.choice((40, 48, 64))))
        planted[10_000 + i] = f"{docs[i] or ''} the value {key} was seen {docs[i + 50] or ''}"
    words = ["internationalizationOfThingsAndOthers", "this_is_an_ordinary_identifier_in_snake_case",
        "path/to/some/ordinary/file/in/folders", "ANOTHERORDINARYCONSTANTNAMEINCAPITALS", "1111111111111111111111111111111111",
        "00000000000000000000000000000123"]
    for i, w in enumerate(words):
        planted[20_000 + i] = f"we call it {w} here"
    rows = spark.createDataFrame(list(planted.items()), "doc_id long, text string")
    got = {r.doc_id: [s for s in r.spans if s.kind == 3] for r in secret_scan.found_secrets(secret_scan.scan(rows)).collect()}
    assert sum(len(got[10_000 + i]) == 1 for i in range(40)) >= 36
    assert not any(got[20_000 + i] for i in range(len(words))) and sum(bool(got[i]) for i in docs) <= 2


def test_many_secrets_in_one_text_take_linear_time():
    import time

    from skein.llm import secret_scan

    text = " ".join(f"token = abcdefgh{i:08d} qwertzuiopasdfghjklyx{i}" for i in range(20_000))
    began = time.time()
    assert len(secret_scan.candidates(text, secret_scan.base_spans(text))) == 20_000 and time.time() - began < 20
    assert secret_scan.cuts({5: np.eye(100, dtype=np.int64)[60]}, {}) == {}


def test_recurrence_alone_finds_the_text_of_unnamed_pages(spark):
    """Without article elements and telling names, menus and footers go because they recur on the host."""
    from skein.llm.page_text import extract_text

    page = lambda host, i: f"<html><body><div class=q1><div><a href=/>Start</a> <a href=/x>News {host}</a></div></div><div class=q2><h1>Title {i}</h1><p>Body {i * 31} of the story, told at length for {host}.</p></div><div class=q3><p>Imprint of {host}</p><ul><li>Terms</li><li>Privacy</li></ul></div></body></html>"
    rows = [(100 * h + i, f"http://h{h}/{i}", page(h, i)) for h in range(3) for i in range(8)]
    want = {100 * h + i: f"Title {i} Body {i * 31} of the story, told at length for {h}." for h in range(3) for i in range(8)}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for hints in (True, False):
        assert {r.page_id: r.text for r in extract_text(df, hints=hints).collect()} == want


def test_broken_markup_takes_linear_time():
    import time

    from skein.llm.page_text import Page

    n = 100_000
    for source in ("<a " * (n * 3), '<a "' * n, "<a '\"" * n, "<div>" * n + "</p>" * n + "x" + "</div>" * n, "<article>" * n + "x",
        "<b>" * n + "x", "<!-- " * n, "<![CDATA[" * n, "<script>" * n, "<p class='" * n):
        began = time.time()
        page = Page(source)
        page.text(frozenset(c[0] for c in page.containers))
        assert time.time() - began < 5, source[:12]
    assert Page("<p>a < b and <i>c</i> > d <a href='x>y'>e</a>").text() == "a < b and c > d e"


def test_leaks_against_all_alignments(spark):
    """Items with edits up to the budget, in any script, against the least alignment of every item with every text."""
    from skein.llm import contamination

    def least(item, text):  # item anywhere in text
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(text, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return min(row)

    rng = random.Random(13)
    flat = lambda s: re.sub(r"[ \t-\r]+", " ", (s or "").lower()).strip(" ")
    scripts = ["abcdefghijklmnop    ", "äöüßéèñçåøæabcdef   ", "абвгдежзийклмноп   ", "日本語漢字仮名文章例外 "]
    items, texts = [], []
    for k in range(24):
        letters = scripts[k % 4]
        item = "".join(rng.choice(letters) for _ in range(rng.choice((20, 24, 30, 60, 90))))
        items.append((k if k % 7 else None, item))
        for edits in (0, 2, len(item) // 10, len(item) // 10 + 3):
            x = list(item)
            for _ in range(edits):
                at = rng.randrange(len(x))
                x[at : at + 1] = rng.choice(([], [rng.choice(letters)], [x[at], rng.choice(letters)]))
            pad = lambda: "".join(rng.choice(letters) for _ in range(40))
            texts.append(pad() + " " + "".join(x).upper().replace("SS", "ß") + " " + pad())
    texts += [None, "", "x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.item_id, r.distance)
        for r in contamination.find_leaks(rows, spark.createDataFrame(items, "item_id long, text string")).collect())
    want = collections.Counter()
    for item_id, item in items:
        x = flat(item)
        e = min(int(0.1 * len(x)), (len(x) - 8) // 8)
        if len(x) < 24:
            continue
        for i, text in enumerate(texts):
            d = least(x, flat(text))
            if d <= e:
                want[i, item_id, d] += 1
    assert got == want and sum(want.values()) > 40 and None in {k for _, k, _ in want}
