"""Every operator against a brute-force version, and on odd rows: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import itertools
import random
import unicodedata
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tests.llm.conftest import ODD
from tidegraph.llm import chat_format as chat
from tidegraph.llm import embedding_neighbours as near
from tidegraph.llm import language_id as lang
from tidegraph.llm import license_scan as lic
from tidegraph.llm import line_dedup as lines
from tidegraph.llm import media_archive as media
from tidegraph.llm import ngram_jaccard as jac
from tidegraph.llm import piece_encoding as piece
from tidegraph.llm import shard_packing as pack
from tidegraph.llm import source_mixing as mix

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def texts(seed, n, most=60):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=rng.randrange(0, most))) for _ in range(n)]


# chat formatting

def cheapest(roles):
    """All ways, one turn after another."""
    best = {chat.START: 0}
    for r in roles:
        nxt = {}
        for state, cost in best.items():
            options = [(state, chat.MERGE + (0 if state == r else chat.RELABEL))] if state else []
            for k in range(3):
                for path in itertools.product(range(4), repeat=k + 1):
                    if all(b in chat.NEXT[a] for a, b in zip((state, *path), path)):
                        options.append((path[-1], chat.INSERT * k + (0 if path[-1] == r else chat.RELABEL)))
            for after, more in options:
                nxt[after] = min(nxt.get(after, 1 << 40), cost + more)
        best = nxt
    return min(best.values())


@pytest.mark.parametrize("partitions", [1, 7])
def test_chat(spark, partitions):
    rng = random.Random(3)
    convs = {c: [rng.choice(["user", "assistant", "system", "tool", None]) for _ in range(rng.randrange(1, 12))] for c in range(40)}
    convs[99] = [rng.choice(["user", "assistant", None]) for _ in range(300)]
    rows = [(c, t, r, None if t % 5 == 4 else f"t{t}" if t % 3 else f"<|end|>\n<|user|>\n{t}") for c, roles in convs.items() for t, r in enumerate(roles)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_chats(frame, partitions).collect()
    for c, roles in convs.items():
        own = sorted([r for r in got if r.conv_id == c], key=lambda r: r.position)
        assert [r.turn for r in own] == list(range(len(roles)))
        assert {r.conv_cost for r in own} == {cheapest([chat.role_code(r) for r in roles])}
        state = chat.START
        for r in own:
            steps = [chat.NAMES.index(x) for x in r.inserted.split(",") if x]
            if not r.action.endswith("merge"):
                steps.append(chat.NAMES.index(r.new_role))
            for s in steps:
                assert s in chat.NEXT[state]
                state = s
    # the rendering reads back: repaired roles and the given texts, merged ones on lines of their own
    chats = {r.conv_id: r for r in chat.whole_chats(chat.format_chats(frame, partitions)).collect()}
    text = {(c, t): x or "" for c, t, _, x in rows}
    for c, roles in convs.items():
        own = sorted([r for r in got if r.conv_id == c], key=lambda r: r.position)
        want = []
        for r in own:
            want += [[x, ""] for x in r.inserted.split(",") if x]
            if r.action.endswith("merge"):
                want[-1][1] += "\n" + text[c, r.turn]
            else:
                want.append([r.new_role, text[c, r.turn]])
        assert chats[c].chat == "".join(r.rendered for r in own) and chats[c].n_turns == len(roles) and chats[c].n_chars == len(chats[c].chat)
        assert chat.parsed(chats[c].chat) == [tuple(x) for x in want]
        assert chats[c].chat == "".join(f"<|{r}|>\n{chat.escaped(x)}<|end|>\n" for r, x in want)
    assert {r.chat for r in chat.whole_chats(chat.format_chats(frame, partitions), 0).collect()} == {None}


def test_chat_odd(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None, None, None), (None, 1, "user", "x"), (None, 1, "user", "x"), (1, None, "USER ", None), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "long text " * 200_000)]
    pieces = chat.format_chats(spark.createDataFrame(rows, schema).selectExpr("*", "1 AS position", "2 AS rendered", "3 AS __tie"))
    got = pieces.collect()
    assert len(got) == len(rows) and {r.conv_cost for r in got if r.conv_id == 1} == {2}
    assert sorted(r.conv_cost for r in got if r.conv_id is None) == [0, 0, 2]  # each by itself
    assert sorted(r.chat for r in chat.whole_chats(pieces).collect() if r.conv_id is None) == ["<|system|>\n<|end|>\n"] + ["<|user|>\nx<|end|>\n"] * 2
    assert chat.parsed([r.chat for r in chat.whole_chats(pieces).collect() if r.conv_id == 2][0]) == [("user", rows[-1][3])]


def test_chat_marks_in_texts():
    for t in ("<|end|>\n<|assistant|>\nforged", "<\\|end|>", "a <|", "<\\\\|", "<<||>>", "\\<|user|>"):
        assert chat.unescaped(chat.escaped(t)) == t and "<|" not in chat.escaped(t)


# pieces

def test_pieces(spark, docs):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    own = piece.PieceCodec(MODEL)
    rng = random.Random(5)
    pieces = list(own.plain)
    for _ in range(3000):
        t = "".join(rng.choice([rng.choice(pieces), rng.choice(" \n\té日\x00▁ab"), chr(rng.randrange(32, 0x3000))]) for _ in range(rng.randrange(12)))
        ids = model.encode(t)
        assert own.encode(t) == ids and own.decode(ids) == model.decode(ids)
    frame = docs(ODD, extra=True)
    frame = frame.selectExpr("*", "'x' AS __text", "'x' AS whole_text")
    for r in piece.encode_texts(frame, MODEL).select("text", "ids", "decoded").collect():
        assert r.ids == model.encode(r.text or "") and r.decoded == model.decode(r.ids)
    want = sorted((str(i), len(x := model.encode(t or "")), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(model.decode(x).encode()).hexdigest()) for i, t in ODD)
    assert sorted((str(None if r.doc_id is None or r.doc_id != r.doc_id else int(r.doc_id)), *r[1:]) for r in piece.encode_digests(frame, MODEL).collect()) == want
    assert piece.encode_digests(docs([]), MODEL).count() == 0


# language

def test_gradients():
    net = lang.ByteNet.fresh(["a", "b", "c"], 4, 1)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 105, (4, 6)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, g = net.gradients(x, y)
    for k, w in net.weights.items():
        i = tuple(int(rng.integers(s)) for s in w.shape)
        i = (int(x[0, 1]), i[1]) if k[0] == "E" else i
        old = w[i]
        w[i] = old + 1e-4
        up = net.gradients(x, y)[0]
        w[i] = old - 1e-4
        down = net.gradients(x, y)[0]
        w[i] = old
        assert abs((up - down) / 2e-4 - g[k][i]) < 1e-3


def test_language(spark, docs):
    rng = random.Random(2)
    kinds = {"xx": ["bra", "kot", "zil"], "yy": ["mau", "ona", "iel"]}
    rows = [(i, " ".join("".join(rng.choices(kinds[k], k=3)) for _ in range(30)), k, "s") for i in range(90) for k in [["xx", "yy"][i % 2]]]
    frame = docs(rows + [(1000 + i, *r[1:], None, "s") for i, r in enumerate(ODD)])
    net = lang.train_language_net(frame, steps=250)
    got = lang.predict_language(frame.selectExpr("*", "'x' AS score"), net).collect()
    assert all(r.lang == r.lang_pred for r in got if r.lang)
    for r in got:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(unicodedata.category(c)[0] == "L" for c in r.text or ""))
        assert (r.lang_pred == "und") == (r.score == 0)
    assert lang.train_language_net(docs([])) is None
    assert {r.lang_pred for r in lang.predict_language(frame, None).collect()} == {"und"}
    signs = docs([(1, "½"), (2, "② 12 Ⅷ"), (3, "½ a"), (4, "_"), (5, "ªº")])
    assert [r.lang_pred == "und" for r in lang.predict_language(signs, net).orderBy("doc_id").collect()] == [True, True, False, True, False]
    assert sorted((r.doc_id or 0, r.lang_pred, r.score) for r in got) == sorted((r.doc_id or 0, r.lang_pred, r.score) for r in lang.predict_language(frame.repartition(3), net).collect())


def plain_prediction(net, text):
    """Position by position: both directions over each window, probabilities summed over the positions that count."""
    w = {k: v.astype(np.float64) for k, v in net.weights.items()}
    n, data = len(w["Uf"]), text.encode()
    total = np.zeros(len(net.langs))

    def state(d, h, byte):
        e, u = w["E" + d][byte], w["U" + d]
        gates = 1 / (1 + np.exp(-(e[: 2 * n] + h @ u[:, : 2 * n])))
        new = np.tanh(e[2 * n :] + (gates[n:] * h) @ u[:, 2 * n :])
        return (1 - gates[:n]) * h + gates[:n] * new

    for at in range(0, len(data), lang.CORE):
        seen = [data[k] if 0 <= k < len(data) else 255 for k in range(at - lang.CONTEXT, at + lang.CORE + lang.CONTEXT)]
        f, b = [np.zeros(n)], [np.zeros(n)]
        for k in range(len(seen)):
            f.append(state("f", f[-1], seen[k]))
            b.append(state("b", b[-1], seen[-1 - k]))
        for k in range(lang.CONTEXT, lang.CONTEXT + lang.CORE):
            if seen[k] != 255:
                s = np.concatenate([f[k + 1], b[len(seen) - k]]) @ w["V"] + w["c"]
                total += s - np.log(np.exp(s).sum())
    p = np.exp(total / len(data) - (total / len(data)).max())
    return net.langs[int(p.argmax())], p.max() / p.sum()


def test_language_reads_every_byte(monkeypatch):
    net = lang.ByteNet.fresh(["aa", "bb", "cc"], 5, 3)
    reader, rng = lang.Reader(net), random.Random(8)
    given = ["a", "ab cd", "x" * 95, "y" * 96, "z" * 97, "ä ö 日本 1 2 3 " * 30] + ["".join(rng.choice("abc de\n.é日") for _ in range(rng.randrange(1, 700))) + "a" for _ in range(12)]
    for at_once in (4096, 5):
        monkeypatch.setattr(lang, "AT_ONCE", at_once)
        for t, name, score in zip(given, *reader.classify(given), strict=True):
            want = plain_prediction(net, t)
            assert name == want[0] and abs(score - want[1]) < 1e-4
    first, last = reader.classify(["a" * 500])[1], reader.classify(["a" * 250 + " " + "a" * 249])[1]
    assert first != last  # a space counts
    many = reader.classify(["one long text " * 100_000])
    assert abs(many[1][0] - reader.classify(["one long text " * 10_000])[1][0]) < 1e-3


# embeddings

def test_neighbours(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(200 + i, (base[i % 9] + rng.normal(size=16) * 0.12).tolist()) for i in range(150)]
    rows += [(400, base[0].tolist()), (401, [0.0] * 16), (402, None), (403, [None] * 16), (404, [float("nan")] * 16), (405, [1.0, 2.0]), (406, [2.0, 4.0]), (407, []), (None, base[0].tolist()), (408, (base[3] * 1e200).tolist())]
    got = {r.vec_id: r for r in near.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS n", "2 AS component")).collect()}
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = {i: {j for j, w in good if i != j and len(v) == len(w) and (v / np.abs(v).max()) @ (w / np.abs(w).max()) >= 0.9 * np.linalg.norm(v / np.abs(v).max()) * np.linalg.norm(w / np.abs(w).max())} for i, v in good}
    seen = {}
    for i in sorted(links):
        todo = [i] if i not in seen else []
        while todo:
            j = todo.pop()
            if j not in seen:
                seen[j] = i
                todo += links[j]
    for i, _ in rows:
        r = got[i]
        assert (r.n_links, r.component_id, r.kept) == (len(links.get(i, ())), seen.get(i, i), i is not None and seen.get(i, i) == i)
    assert near.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_audit_counts_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    big = rng.normal(size=16) + 0.01 * rng.normal(size=(200, 16))
    pairs = np.repeat(rng.normal(size=(20, 16)), 2, axis=0) + 0.001 * rng.normal(size=(40, 16))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate([*big, *pairs])], "vec_id long, embedding array<double>")
    nodes = near.clean_vectors(rows)
    label = spark.createDataFrame([(i, 0) for i in range(200)], "node long, component long")  # no pair is found
    assert near.missed_share(nodes, label, 0.99, 256, 1) > 0.1
    monkeypatch.setattr(near, "TURNS", 1)
    monkeypatch.setattr(near, "missed_share", lambda *_: 0.5)
    with pytest.raises(RuntimeError):
        near.near_duplicates(rows).count()


# lines

def test_patience():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(12))] for _ in "ab")
        m = lines.patience_matches(a, b)
        assert all(a[i] == b[j] for i, j in m) and all(x < y and p < q for (x, p), (y, q) in itertools.pairwise(m))
        assert lines.patience_matches(a, a) == [(i, i) for i in range(len(a))]


def test_lines(spark, docs):
    block = "this line has more than five words\nshort\nand here is another line of words"
    rows = [(1, f"intro of the first\n{block}\nend one"), (2, f"other start\n{block}\nend two"), (3, f"intro of the first\n{block}\nend one"), (4, "nothing in common with any other text"), (5, "short\nlonely words")]
    frame = docs(rows + [(100 + k, f"own line number {k}\nboilerplate line that everybody has here") for k in range(80)], extra=True)
    got = {r.doc_id: r for r in lines.dedup_lines(frame).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "other start\nend two" and got[3].text == "" and got[4].n_removed == 0 and got[5].text == rows[4][1]
    assert sum("boilerplate" in got[100 + k].text for k in range(80)) == 1 and "boilerplate" in got[100].text
    assert (got[2].n_lines, got[2].n_removed, got[2].removed_words) == (5, 3, 15)
    odd = lines.dedup_lines(docs(ODD)).collect()
    assert len(odd) == len(ODD) and lines.dedup_lines(docs([])).count() == 0
    assert sorted(len(r.text) for r in odd if r.doc_id == 8) == [0, 0]


def test_patience_without_unique_lines():
    p = [1, 2, 3]
    assert [(i, j) for i, j in lines.patience_matches([7, *p, 8, *p, 9], [5, *p, 6]) if j in (1, 2, 3)] == [(5, 1), (6, 2), (7, 3)]


def common_runs(rows, min_words=5):
    """Texts without the lines in runs of at least ``min_words`` words that the text of a smaller doc_id has, by comparing all places."""
    split = [(i, t.split("\n")) for i, t in rows]
    out = []
    for i, own in split:
        gone = set()
        for other in [x for j, x in split if j < i]:
            if own == other:
                gone |= set(range(len(own)))
            for x in range(len(own)):
                for y in range(len(other)):
                    n = 0
                    while x + n < len(own) and y + n < len(other) and own[x + n] == other[y + n]:
                        n += 1
                    if sum(len(w.split()) for w in own[x : x + n]) >= min_words:
                        gone |= set(range(x, x + n))
        out.append("\n".join(w for k, w in enumerate(own) if k not in gone))
    return out


def test_repeated_moved_and_frequent_blocks(spark, docs):
    p, verse = "three short words\nand two", "roses are\nred violets\nare blue"
    texts = ["u\n" + p + "\nv", f"x\n{p}\ny\n{p}\nz", "moved one block of five\nsecond moved block of words", "second moved block of words\nmiddle\nmoved one block of five"]
    texts += [f"own text {k}\n{verse}\ntail {k}" for k in range(80)]  # lines met over 64 times, none of 5 words
    texts += ["a b\nfirst", "c d\nsecond", "e f\nthird", "a b\nc d\ne f\nB", "a b\nc d\ne f\nC"]
    texts += ["aa bb cc", "dd ee ff", "aa bb cc\ndd ee ff", "aa bb cc\ndd ee ff"]  # first holders of the lines, then of the block
    rng = random.Random(4)
    texts += ["\n".join(rng.choice(["", "p", "q r", "s t u", "v w x y z"]) for _ in range(rng.randrange(1, 9))) + f"\n{k}" for k in range(60)]
    rows = list(enumerate(texts))
    # versions of one document: each loses what earlier documents have, and nothing to the other
    rows += [(500, "only here and nowhere else so\nroses are\nred violets\nare blue"), (500, "five words of one version\nfive words of one version"), (500, "five words of one version\nprecious unique line nobody has"), (501, "x y\nfive words of one version")]
    want = common_runs(rows)
    assert want[1] == "x\ny\nz" and want[3] == "middle" and want[83] == "own text 79\ntail 79" and want[88] == "C" and want[92] == ""
    assert want[-4:] == ["only here and nowhere else so", rows[-3][1], rows[-2][1], "x y"]
    got = lines.dedup_lines(docs(rows).selectExpr("*", "'x' AS __gone", "'x' AS key", "'x' AS drop", "doc_id AS __doc")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted((i, t) for (i, _), t in zip(rows, want, strict=True))
    split = [t.split("\n") for t in texts]
    for a, b in itertools.product(split[-60:], split[-60:]):  # an alignment through every shared run finds all that runs show, and no more
        (ha, wa), (hb, wb) = ((np.array([hash(x + ".") for x in t]), np.array([len(x.split()) for x in t])) for t in (a, b))
        one, two = lines.short_runs([ha], [wa], 5), lines.short_runs([hb], [wb], 5)
        shown = {i for lo, hi, h in zip(*one[1:], strict=True) if h in two[3] for i in range(lo, hi)}
        assert set(lines.aligned_lines(ha, wa, hb, wb, 5).tolist()) == shown


def test_lines_many_holders_and_long_texts(spark, docs):
    """A line that 65 and 1000 documents have, and a text of very many lines, copied in part."""
    long = "\n".join(f"line {k} of a very long text" for k in range(8000))
    rows = [(k, f"own words of text number {k}\nthis line stands in very many documents" + ("\nand this one in a few of them" if k < 65 else "")) for k in range(1000)]
    rows += [(2000, long), (2001, "a start of its own here\n" + long[: len(long) // 2].rsplit("\n", 1)[0] + "\nan end of its own here")]
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs(rows)).collect()}
    assert got[0] == rows[0][1] and all(got[k] == f"own words of text number {k}" for k in range(1, 1000))
    assert got[2000] == long and got[2001] == "a start of its own here\nan end of its own here"


# media

def test_media(spark, docs, tmp_path):
    rows = [r for r in ODD] + [(20 + k, "é" * k) for k in (31, 32, 33, 64)]
    got = media.archive_and_inspect(docs(rows, extra=True)).collect()
    want = []
    for i, t in rows:
        b = (t or "").encode()
        p = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        image = media.to_image(b)
        assert media.from_image(image) == (p, len(b))
        want.append((i is None, i or 0, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(image), hashlib.sha256(image).hexdigest(), media.image_feature(p)))
    assert sorted((r.doc_id is None, r.doc_id or 0, *r[1:]) for r in got) == sorted(want)
    assert media.archive_and_inspect(docs([])).count() == 0


def test_archive_ranges_and_retries(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/a"
    n = media.write_archives(docs([(k, f"text {k} " * 50) for k in range(200)]), folder, 4096).agg({"members": "sum"}).first()[0]
    assert n == 200
    got = media.read_archives(spark, folder, rangeBytes="1000", batchBytes="500").collect()
    assert sorted(r.doc_id for r in got) == list(range(200)) and all(r.error is None for r in got)
    reader = media.ArchiveReader({"path": folder})
    r = got[0]
    good = reader._retried(r.archive, r.offset, len(r.media), zlib.crc32(r.media))
    assert good == (bytes(r.media), None)
    assert reader._retried(r.archive, r.offset + 1, 5, 0)[1].startswith("ValueError")
    spoiled = tmp_path / "a" / r.archive
    data = bytearray(spoiled.read_bytes())
    data[r.offset + 60] ^= 255
    spoiled.write_bytes(bytes(data))
    bad = [x for x in media.read_archives(spark, folder).collect() if x.error]
    assert [(x.doc_id, x.media) for x in bad] == [(r.doc_id, None)]
    assert len([x for x in media.media_features(media.read_archives(spark, folder)).collect() if x.n_bytes is None]) == 1
    with pytest.raises(Exception, match="BadZipFile|checksum differs"):
        media.media_features(media.read_archives(spark, folder), strict=True).collect()


# licences

def test_licenses(spark, docs):
    rng = random.Random(6)
    filler = texts(8, 60)
    rows = []
    for k, (name, t) in enumerate(sorted(lic.TEMPLATES.items())):
        words = t.split()
        rows += [(k, f"{filler[k]} {t} {filler[k + 1]}"), (100 + k, t.upper().replace(" ", "!! ")), (200 + k, " ".join(words[: len(words) // 2])), (300 + k, " ".join(w if rng.random() > 0.02 else "zzz" for w in words))]
    rows.append((900, " ".join(lic.TEMPLATES.values())))
    frame = docs(rows + [(1000 + i, r[1]) for i, r in enumerate(ODD)], extra=True)
    got = lic.scan_licenses(frame)
    con = duckdb.connect()
    con.register("documents", frame.select("doc_id", "text").toPandas())
    want = con.execute(lic.scan_licenses_sql())
    columns = [c[0] for c in want.description]
    rounded = lambda rows: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows)
    assert rounded(tuple(r) for r in got.select(columns).collect()) == rounded(want.fetchall())
    assert {r.doc_id for r in got.collect()} >= {900, *range(len(lic.TEMPLATES))}
    assert lic.scan_licenses(docs([])).count() == 0


# mixing

def quotas(votes, seats):
    got = [0] * len(votes)
    for _ in range(seats):
        got[max(range(len(votes)), key=lambda i: votes[i] / (2 * got[i] + 1))] += 1
    return got


def test_sainte_lague(spark):
    from pyspark.sql import functions as F

    rng = random.Random(7)
    for seats in (0, 1, 5, 37, 200):
        votes = [rng.choice([0, 1, 3, 10, 50, 997]) * rng.random() for _ in range(9)]
        frame = spark.createDataFrame([(0, i, v) for i, v in enumerate(votes)], "g int, u int, v double")
        got = {r.u: r.quota for r in mix.sainte_lague(frame, ["g"], "u", "v", F.lit(seats)).collect()}
        assert [got[i] for i in range(9)] == quotas(votes, seats)


def test_mixing(spark, docs):
    rng = random.Random(9)
    names = ["b", "a", "c", None, "hot", "é"]
    rows = [(i, " ".join(["w"] * rng.randrange(0, 200)), "en", rng.choice(names) if i % 3 else "hot") for i in range(600)] + [(600, None, "en", "a"), (601, "x y", "en", "tiny"), (601, "x y", "en", "tiny")]
    frame = docs(rows, extra=True)
    first = sorted(map(str, mix.mix_sources(frame).collect()))
    got = mix.mix_sources(frame.repartition(7)).collect()
    assert sorted(map(str, got)) == first
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    target, free, total = {}, set(order), float(sum(sizes.values()))
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target.update(share)
            break
        target.update({s: 3.0 * sizes[s] for s in over})
        free -= over
    taken = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 64 for s in sizes)
    # blocks are picked all over a source, not from one run of it
    own = sorted([r for r in mix.mix_sources(spark.range(4000).selectExpr("id AS doc_id", "repeat('w ', 64) AS text", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS source")).collect() if r.source == "a"], key=lambda r: r.doc_id)
    assert abs(sum(r.taken for r in own) - own[0].target) <= 64 and {r.taken for r in own} == {0, 64}
    assert mix.mix_sources(docs([])).count() == 0
    assert {r.taken for r in mix.mix_sources(docs([(1, None), (2, "")])).collect()} == {0}


# shards

def test_shards(spark, docs):
    rng = random.Random(10)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(1, 80)))) for i in range(2000)] + [(3000 + i, "copied text of some words") for i in range(150)] + [(9000 + i, *r[1:]) for i, r in enumerate(ODD) if i not in (5, 6, 7, 8)]
    got = pack.shard_documents(docs(rows, extra=True)).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    text = dict(rows)
    where, size = {}, {}
    for r in got:
        assert r.size == len((text[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode())
        where.setdefault(text[r.doc_id] or "", set()).add(r.shard)
        size[r.shard] = size.get(r.shard, 0) + r.size
    assert all(len(s) == 1 for s in where.values())
    assert max(size.values()) <= 1.02 * min(size.values()) and set(size) == set(range(8))
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    hot = pack.shard_documents(docs([(i, "only text") for i in range(400)])).collect()
    assert len({r.shard for r in hot}) == 8
    assert pack.shard_documents(docs([])).count() == 0


@pytest.mark.parametrize("n", [3000, 60_000])
def test_shards_whatever_the_number(spark, docs, n):
    rng = random.Random(12)
    rows = [(i, f"{i} " + " ".join(rng.choices(WORDS, k=5 + min(300, int(4 * rng.paretovariate(1.5)))))) for i in range(n)] + [(n + i, f"{i % 40} twice or more") for i in range(400)]
    frame = docs(rows)
    few = {} if n > 3000 else {"heavy_share": 64, "lanes": 4, "spare": 200}
    got = pack.shard_documents(frame, **few).toPandas()
    assert len(got) == len(rows) and (got.groupby(["text_crc32", "size"])["shard"].nunique() == 1).all()
    got["words"] = got["doc_id"].map({i: len(t.split()) for i, t in rows})
    by = got.groupby("shard").agg(bytes=("size", "sum"), words=("words", "sum"), rows=("size", "count"), slots=("slot", "nunique"), last=("slot", "max"))
    assert len(by) == 8 and (by["slots"] == by["rows"]).all() and (by["last"] + 1 == by["rows"]).all()
    assert by["bytes"].max() - by["bytes"].min() <= got["size"].median()  # less than a usual text
    assert by["words"].max() <= 1.02 * by["words"].min() and by["rows"].max() <= 1.1 * by["rows"].min()
    again = pack.shard_documents(frame.repartition(3), **few).toPandas()
    assert got.drop(columns="words").sort_values("doc_id", ignore_index=True).equals(again.sort_values("doc_id", ignore_index=True))


# n-grams

@pytest.mark.parametrize("width, percent", [(3, 50), (3, 67), (5, 80), (3, 90), (3, 100)])
def test_jaccard(spark, docs, width, percent):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(4000)]
    rows = []
    for g in range(12):
        base = rng.choices(vocabulary, k=rng.randrange(30, 250))
        for _ in range(rng.randrange(1, 40)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                copy = copy[: -rng.randrange(1, 8)]
            rows.append(" ".join(copy))
    rows = list(enumerate(rows)) + [(5000 + k, t) for k, t in enumerate(["One", "one", "one two", "ONE two", "one two three", "Ä b", "ä b", "same words " * 50, "same words " * 70])]
    rows += [(6000 + i, t) for i, (_, t) in enumerate(ODD)]
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    for crowd in (2, 16):
        got = {r.doc_id: r for r in jac.jaccard_components(docs(rows, extra=True), width, percent, crowd).collect()}
        assert {i: (got[i].n_shingles, got[i].component_id) for i in sets} == {i: (len(s), root(i)) for i, s in sets.items()}
    assert jac.jaccard_components(docs([]), width, percent).count() == 0
    odd = jac.jaccard_components(docs(ODD), width, percent).collect()
    assert len(odd) == len(ODD) and [r.component_id for r in odd if r.doc_id is None] == [None]


def test_parity_bits():
    rng = np.random.default_rng(12)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 900), dtype=np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) < rng.random()], rng.integers(0, 1 << 63, rng.integers(1, 400), dtype=np.uint64)])
        bits = jac.differing_bits(jac.parity_bits(a), jac.parity_bits(b))
        assert bits <= len(np.setxor1d(a, b)) and jac.differing_bits(jac.parity_bits(a), jac.parity_bits(a)) == 0


def test_language_of_few_texts(spark, docs):
    few = spark.range(20_000).selectExpr("id AS doc_id", "concat('wenige verschiedene worte ', CAST(id % 2 AS string)) AS text", "'de' AS lang")
    some = spark.range(20_000, 20_060).selectExpr("id AS doc_id", "concat('plain english words ', CAST(id AS string)) AS text", "'en' AS lang")
    assert lang.train_language_net(few.union(some), steps=2).langs == ["de", "en"]
