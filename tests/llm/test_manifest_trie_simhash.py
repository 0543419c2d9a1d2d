"""Operators 11 to 13 against brute force, on the test tables and on odd rows."""

import collections
import functools
import hashlib
import random
import zlib

import duckdb
import pytest
import xxhash

FOLDER = "/root/testdata/sf0.001"
LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(name, order):
    return duckdb.sql(f"SELECT * FROM '{FOLDER}/{name}.parquet' ORDER BY {order}").fetchall()


def ask(spark, name):
    import __spark_entry__

    return __spark_entry__.queries()[name](spark, FOLDER).collect()


def plain_print(text):
    words = (text or "").encode().translate(LOW).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, linked):
    """Least node reachable of each node, by a plain search."""
    least = {}
    for start in sorted(nodes):
        if start in least:
            continue
        todo = [start]
        least[start] = start
        while todo:
            x = todo.pop()
            for y in nodes:
                if y not in least and linked(x, y):
                    least[y] = start
                    todo.append(y)
    return least


def check_simhash(rows, docs):
    prints = [(i, plain_print(t)) for i, t in docs]
    alone = collections.defaultdict(list)
    for i, p in prints:
        alone[p].append(i)
    root = classes(list(alone), lambda a, b: (a ^ b).bit_count() <= 3)
    named = collections.defaultdict(list)
    for p, ids in alone.items():
        named[root[p]] += [i for i in ids if i is not None]
    want = collections.Counter((i, f"{p:016x}", min(named[root[p]], default=None)) for i, p in prints)
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows) == want


def test_simhash_of_the_test_table(spark):
    check_simhash(ask(spark, "op11_simhash_duplicates"), [(r[0], r[1]) for r in table("documents", "doc_id")])


def test_simhash_of_odd_rows(spark):
    from skein.llm.simhash import simhash_duplicates

    long = " ".join(f"w{i % 977}" for i in range(200_000))
    docs = [(5, None), (4, ""), (3, " \t\n"), (7, "one"), (7, "one"), (None, "ONE"), (8, "one two"), (9, long), (1, long + " end"),
        (None, "é　x y z")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, print string, component_id string")
    check_simhash(simhash_duplicates(df).collect(), docs)
    assert simhash_duplicates(df.limit(0)).collect() == []


def test_dense_prints_are_joined_at_every_depth(spark, tmp_path, monkeypatch):
    from skein.llm import simhash
    from skein.llm.graph import components
    from skein.llm.storage import Stage

    random.seed(3)
    center = random.getrandbits(64)
    prints = {center ^ sum(1 << b for b in random.sample(range(64), random.randrange(2, 9))) for _ in range(500)} | {random.getrandbits(64)
        for _ in range(100)}
    want = classes(list(prints), lambda a, b: (a ^ b).bit_count() <= 3)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    monkeypatch.setattr(simhash, "MOST", 12)  # so that buckets are split, and split into tiles at the last
    stage = Stage(spark, "test")
    df = spark.createDataFrame([(signed(p),) for p in prints], "print long")
    links = simhash.links_within(df, stage)
    assert not spark.read.parquet(f"{stage.path}/links-tiles").isEmpty()
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in components(links, stage, "c").collect()}
    same = lambda of: {frozenset(p for p in prints if of.get(p, p) == c) for c in {of.get(p, p) for p in prints}}
    assert same(got) == same(want)


def plain_trie(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    convs = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    members = collections.defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children, leaves, saved = collections.Counter(), collections.Counter(), collections.Counter()
    for node in sorted(members, key=len, reverse=True):
        words = len(node[-1][1].split()) if node else 0
        leaves[node] += not children[node]
        saved[node] += (len(members[node]) - 1) * words
        if node:
            children[node[:-1]] += 1
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    out = collections.Counter()
    for node, ids in members.items():
        ends = hashlib.sha256(",".join(str(c) for c in ids if len(built[c]) == len(node)).encode()).hexdigest()
        out[ids[0], len(node), members[node[:-1]][0] if node else None, len(ids), children[node], leaves[node], saved[node], ends] += 1
    return out


COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def check_trie(rows, source):
    got, want = collections.Counter(tuple(r[c] for c in COLUMNS) for r in rows), plain_trie(source)
    assert got == want


def test_trie_of_the_test_table(spark):
    check_trie(ask(spark, "op12_prefix_trie"), table("conversations", "conv_id, turn"))


def test_trie_of_odd_rows(spark):
    from skein.llm.prefix_trie import prefix_trie

    random.seed(11)
    rows = [(None, 1, "user", "lost"), (-3, 0, "user", "negative"), (41, None, None, None), (41, 2, "user", "b"), (41, 2, "user", "a  a"),
        (41, 2, "user", "b")]
    rows += [(1000, t, "user", f"long turn {t}") for t in range(300)]  # one conversation stretches over tasks
    rows += [(1003, t, "user", f"long turn {t}") for t in range(280)]
    rows += [(c, t, "user", f"turn {t}") for c in range(60, 110) for t in range(c - 59)]  # each a prefix of the next
    rows += [(c, t, random.choice(["user", "assistant"]), random.choice("xy")) for c in range(2000, 2300)
        for t in range(random.randrange(1, 5))]
    rows += [(c, 0, "user", "the same") for c in range(9000, 9400)]
    random.shuffle(rows)
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, depth string")
    check_trie(prefix_trie(df).collect(), rows)
    assert prefix_trie(df.limit(0)).collect() == []
    check_trie(prefix_trie(df.where("conv_id = 41")).collect(), [r for r in rows if r[0] == 41])


def check_manifest(rows, docs):
    sha = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(fields):
        return sha(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))

    def lift(nodes):
        """Levels up to one node, and for each position its runs."""
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
        return levels

    def walk(levels, at, digest):
        siblings = []
        for nodes in levels[:-1]:
            run, place = nodes[at // 16 * 16 : at // 16 * 16 + 16], at % 16
            siblings += run[:place] + run[place + 1 :]
            digest = sha(*run[:place], digest, *run[place + 1 :])
            at //= 16
        return siblings, digest

    by = collections.defaultdict(list)
    for d in docs:
        by[d[2]].append((d[0] is not None, d[0] or 0, leaf((d[0], d[2], d[3], d[4], d[1])), d))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: lift([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    top = lift([trees[s][-1][0] for s in sources])
    want = collections.Counter()
    for n, s in enumerate(sources):
        for at, (_, _, own, d) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            text = d[1]
            if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0 and text is not None:
                text = text.encode().translate(LOW).decode()
            low, digest = walk(trees[s], at, leaf((d[0], d[2], d[3], d[4], text)))
            high, digest = walk(top, n, digest)
            want[d[0], own, trees[s][-1][0], top[-1][0], sha(*low, *high), digest, digest == top[-1][0]] += 1
    fields = "doc_id leaf subroot root proof_sha256 folded_root verified".split()
    assert collections.Counter(tuple(r[f] for f in fields) for r in rows) == want


def test_manifest_of_the_test_table(spark):
    check_manifest(ask(spark, "op13_merkle_manifest"),
        duckdb.sql(f"SELECT doc_id, text, source, lang, n_chars FROM '{FOLDER}/documents.parquet'").fetchall())


@pytest.mark.parametrize("levels", [1, 2])
def test_manifest_of_odd_rows(spark, tmp_path, monkeypatch, levels):
    from skein.llm import merkle

    monkeypatch.setattr(merkle, "manifest", functools.partial(merkle.manifest, levels=levels))
    docs = [(i, f"Text {i}", "big", "en", 6) for i in range(300)] + [(i, "A", f"s{i}", None, 1) for i in range(400, 440)]
    docs += [(None, None, None, None, None), (None, "é", None, "", 0), (7, "Twice", "big", "en", 5), (7, "Twice", "big", "en", 5),
        (3, "", "", "", 0), (2**60 + 1, "B" * 100_000, "éz", "x", 1)]
    docs += [(i, "x", "exact", None, None) for i in range(256)]
    schema = "doc_id long, text string, source string, lang string, n_chars long"
    path = f"file://{tmp_path}"
    random.seed(1)
    random.shuffle(docs)
    spark.createDataFrame(docs, schema).write.parquet(f"{path}/documents.parquet")
    check_manifest(merkle.op13_merkle_manifest(spark, path).collect(), docs)
    assert merkle.manifest(spark.createDataFrame([], schema)).collect() == []


def test_sql_of_trie_and_manifest(spark):
    """The SQL of both queries gives what brute force gives, on the test tables."""
    from skein.llm import registry

    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")

    def rows(name):
        found = con.execute(registry.ORACLE_SQL[name])
        columns = [c[0] for c in found.description]
        return [dict(zip(columns, r, strict=True)) for r in found.fetchall()]

    check_trie(rows("op12_prefix_trie"), table("conversations", "conv_id, turn"))
    check_manifest(rows("op13_merkle_manifest"), con.execute("SELECT doc_id, text, source, lang, n_chars FROM documents").fetchall())
