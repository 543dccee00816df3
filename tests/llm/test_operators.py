"""Small tests of the llm operators: brute force, round trips, and the stated edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter
from math import log10

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, t string, rule string"
rng = random.Random(5)
WORDS = [a + b for a in "ka mo ti re su".split() for b in "lan ver dor pin gol".split()]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


TEXTS = {
    1: prose(80, 1), 2: prose(80, 1), 3: prose(80, 1) + " one more", 4: prose(400, 2), 5: "Prefix words here " + prose(400, 2), 6: None, 7: "", 8: "   \n ",
    9: "one two", 10: "One TWO", 11: prose(60, 3) + "\n" + prose(30, 4), 12: prose(30, 4) + "\nä ö ü ß " + prose(50, 6), 13: "x" * 3000, 14: "y" + "x" * 3000, 15: "the same line of text\n" * 40,
}


def docs(spark, texts=None):
    texts = TEXTS if texts is None else texts
    return spark.createDataFrame([(i, t, "en" if i % 3 else None, None, None, 1, "clash", "r") for i, t in texts.items()], DOCS)


def words(t):
    return (t or "").encode().lower().split()


def test_loser_trees():
    from lodestrata.llm.loser_tree import front_coded, merged, merged_front_coded

    for _ in range(200):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(6))) for _ in range(rng.randrange(6))) for _ in range(rng.randrange(6))]
        want, out, s = sorted(x for r in runs for x in r), [], b""
        for lcp, rest, _ in merged_front_coded([front_coded([(x, None) for x in r]) for r in runs]):
            s = s[:lcp] + rest
            out.append(s)
        assert out == want
        assert [x for (x,) in merged([[(x,) for x in r] for r in runs], lambda t: t)] == want


def test_warc(spark):
    from lodestrata.llm.warc_index import archive_history

    long = "<p>ü\r\n\r\nWARC/1.0\r\n" + "z" * 100
    rows = [(5, "http://A.example.com/x", long), (3, "https://b.example.com/", long), (9, None, long), (4, "http://c.example.org/\r\nq", "short"), (6, "x", "short"), (7, "http://d/", None), (None, "http://e/", "null id")]
    got = {r.page_id: r for r in archive_history(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 7
    for page, _, html in rows:
        data = (html or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (got[page].record_type, got[page].refers_to) == (("revisit", 3) if html == long and page != 3 else ("response", None))
    assert archive_history(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_licences(spark):
    from lodestrata.llm.license_scan import PHRASES, scanned

    texts = dict(TEXTS) | {20: "Licensed under the Apache License, Version 2.0. MIT license mit LICENSE", 21: "cc by cc by-nc 4.0; apache", 22: "GNU General Public\nLicense ä cc", 23: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"}
    for r in scanned(docs(spark, texts)).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id] or ""))
        places = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        if r.doc_id == 23:
            assert r.labels == "mit"


def test_licence_spans():
    from lodestrata.llm.license_scan import TEMPLATES, Scanner

    label, text = TEMPLATES[0]
    notice = text.encode().split()
    words, want = [], []
    for k in range(5):
        words += [f"filler{i}".encode() for i in range(200 * (k % 2))]
        want.append((label, len(words), len(words) + len(notice) - 1, 1.0))
        words += notice
    assert [s for s in Scanner().scan(words)[1] if s[0] == label] == want
    run = "alpha beta gamma delta"
    scanner = Scanner(templates=[("own", " ".join(f"{run} u{i}" for i in range(30)))], min_match=4, max_gap=3, min_coverage=0.5)
    assert scanner.scan(" ".join(f"{run} v{i}" for i in range(30)).encode().split())[1] == [("own", 0, 148, 0.8)]


def test_decontamination(spark):
    from lodestrata.llm.decontaminate import contaminated

    items = [(1, "What is " + prose(12, 50) + "? " + prose(12, 51)), (2, prose(30, 52)), (3, None), (4, ""), (5, prose(30, 52))]
    texts = dict(TEXTS) | {30: prose(300, 60) + " " + items[0][1] + " " + prose(300, 61), 31: prose(64, 62) + "\n" + items[1][1].upper(), 32: items[0][1].split("?")[0]}
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(spark, docs(spark, texts), frame).collect()}
    assert got == {(30, 1), (31, 2), (31, 5)}
    assert contaminated(spark, docs(spark), frame.limit(0)).count() == 0


def test_language_model(spark):
    from lodestrata.llm.suffix_tree_lm import scored

    texts = {i: (TEXTS.get(i) if i in TEXTS else prose(60, i % 11) + " end") for i in range(1, 60)}
    got = {r.doc_id: r for r in scored(spark, docs(spark, texts)).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    tokens = {i: [*words(t), None] for i, t in texts.items()}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert r.score <= 0
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())
    assert scored(spark, docs(spark).limit(0)).count() == 0


def test_language_model_whole_tree(spark):
    """Every run seen twice counts, whatever share of the input it is; held against a model of tuples."""
    from math import log

    from lodestrata.llm.suffix_tree_lm import MIN_GAIN, PRIOR, scored

    texts = {i: (TEXTS.get(i) if i in TEXTS else prose(60, i % 11) + " end") for i in range(1, 60)}
    texts |= {i: " ".join(f"{a} b c {a}{a} " + prose(3, i * 9 + k) for k, a in enumerate("adadda")) for i in range(60, 75)}
    lines = {i: ["<", *words(t), ">"] for i, t in texts.items()}
    train = [s for i, s in lines.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    n = [Counter(tuple(s[k : k + size]) for s in train for k in range(len(s) - size + 1)) for size in range(1, 5)]
    total = sum(n[0].values()) - len(train)
    uni = {r: (n[0][r] + 0.5) / (total + 0.5 * len(n[0])) for r in {(w,) for s in lines.values() for w in s}}  # the start isn't a word, unseen words count as one
    p, rest, keep = dict(uni), {}, set()
    for size in (2, 3, 4):
        runs = {r: c for r, c in n[size - 1].items() if c >= 2}
        inside = Counter()
        for r, c in runs.items():
            inside[r[:-1]] += c
        gain = {}
        for r in inside:
            rest[r] = n[size - 2][r] - inside[r] + PRIOR
            gain[r] = (rest[r] - PRIOR) * log(rest[r] / (n[size - 2][r] + PRIOR))
        for r, c in runs.items():
            p[r] = (c + rest[r[:-1]] * p[r[1:]]) / (n[size - 2][r[:-1]] + PRIOR)
            gain[r[:-1]] += c * log(p[r] / p[r[1:]])
        keep |= {r[k:] for r, g in gain.items() if g >= MIN_GAIN for k in range(len(r))}
    want = {}
    for i, s in lines.items():
        want[i] = 0.0
        for at in range(1, len(s)):
            q = uni[(s[at],)]
            for size in (1, 2, 3):
                context = tuple(s[max(0, at - size) : at])
                if len(context) < size or context not in keep:
                    break
                c = n[size][(*context, s[at])]
                q = ((c if c >= 2 else 0) + rest[context] * q) / (n[size - 1][context] + PRIOR)
            want[i] += log10(q)
    assert any(len(r) == 3 for r in keep)
    got = {r.doc_id: r.score for r in scored(spark, docs(spark, texts), min_share=0.05).collect()}
    assert got == pytest.approx(want)


def brute_spans(texts, span=50):
    data = {i: (t or "").encode() for i, t in texts.items()}
    first = {}
    for i in sorted(data):
        for p in range(len(data[i]) - span + 1):
            first.setdefault(data[i][p : p + span], i)
    out = {}
    for i, t in data.items():
        gone = [False] * len(t)
        for p in range(len(t) - span + 1):
            if first[t[p : p + span]] < i:
                gone[p : p + span] = [True] * span
        out[i] = (len(t), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest())
    return out


def test_suffix_dedup(spark):
    from lodestrata.llm.suffix_dedup import deduplicated

    texts = {i: t for i, t in TEXTS.items()} | {40: "ä" * 60 + prose(20, 70), 41: "ä" * 59 + prose(20, 70)[3:], 42: prose(20, 71)[:49], 43: prose(20, 71)[:50], 44: "q" + prose(20, 71)[:50]}
    got = {r.doc_id: tuple(r)[1:] for r in deduplicated(spark, docs(spark, texts)).collect()}
    assert got == brute_spans(texts)
    frame = spark.createDataFrame([(None, TEXTS[4]), (4, TEXTS[4]), (4, TEXTS[4])], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.n_removed > 0) for r in deduplicated(spark, frame).collect()) == [(False, False), (False, False), (True, True)]
    assert deduplicated(spark, frame.limit(0)).count() == 0


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, width, percent):
    from lodestrata.llm.partenum_join import jaccard_components

    texts = dict(TEXTS)
    for k in range(60):  # copies of two texts with a few words changed
        w = prose(120 if k % 2 else 300, 80 + k % 2).split()
        for _ in range(k % 7):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts[100 + k] = " ".join(w)
    sets = {i: ({tuple(w[j : j + width]) for j in range(len(w) - width + 1)} or {tuple(w)}) if (w := words(t)) else set() for i, t in texts.items()}
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark, docs(spark, texts), width, percent).collect()}
    assert got == {i: (len(sets[i]), top(i)) for i in texts}


def test_quality(spark):
    from lodestrata.llm.quality import judged

    texts = dict(TEXTS) | {50: " ".join(f"{w}###" for w in prose(200, 90).split()), 51: prose(60, 91) + " a b c d a b c"}
    got = {r.doc_id: r for r in judged(spark, docs(spark, texts), min_reference=100, max_class=0.25).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        w, lines = re.findall(r"[^\x20\x09-\x0D]+", t or ""), [x for x in (t or "").split("\n") if x.strip()]
        runs = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(runs)
        covered = {k + d for k, run in enumerate(runs) if n[run] > 1 for d in range(3)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 2 * len(covered) > len(w)) and not (r.base_failed and r.kept)
    assert not got[50].base_failed and not got[50].kept and got[4].kept


def test_url_filter(spark):
    from lodestrata.llm.url_filter import RULES, Segmenter, filtered

    urls = ["http://A.Example.com/en/70?x", "https://example.net/de/8", "http://x.net/de/9#f", "http://x.org", "nothing", None, "s://h?x://y/", "https://q.org/es/1", "http://notexample.com/en/7"]
    rows = [(i, u, "<title>Some words here</title>" if i % 2 else None) for i, u in enumerate(urls)]
    for r in filtered(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        u = urls[r.page_id] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [(h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and verdict in (None, r.verdict)
    assert Segmenter({"some": 50, "words": 40, "here": 9, "so": 3}).split("somewordshere") == ("some", "words", "here")


def test_url_filter_rare_words(spark):
    """Words and tokens of any share count; held against the same models over dicts."""
    from math import log

    from lodestrata.llm.url_filter import Segmenter, filtered

    r = random.Random(9)
    rows = [(i, f"http://{r.choice(WORDS)}{r.choice(WORDS)}.{r.choice(['com', 'net', 'org', 'io'])}/{r.choice(['en', 'de', 'es'])}/{i}/{r.choice(WORDS)}-{r.choice(WORDS)}{i % 7 and 'qqx'}", f"<title>{prose(3, i)}</title>") for i in range(300)]
    rows += [(None, None, None), (5, "x", "")]
    got = filtered(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), min_share=0.02).collect()
    assert len(got) == len(rows)
    c = Counter(w for *_, h in rows if h for w in h[7:-8].split())
    segmenter = Segmenter({w: n for w, n in c.items() if n >= 2})
    tokens, seen, pages = {}, {"allow": Counter(), "block": Counter()}, Counter()
    for x in got:
        found = [(m, run) for m, text in (("h:", x.host), ("p:", x.path.lower())) for run in re.findall(r"[^\W\d_]+|\d+", text)]
        tokens[x.host, x.path] = [t for m, run in found for t in ([f"{m}#{min(len(run), 4)}"] if run.isdigit() else [m + w for w in segmenter.split(run)])]
        if x.rule:
            seen[x.verdict].update(tokens[x.host, x.path])
            pages[x.verdict] += 1
    size = len({*seen["allow"], *seen["block"]}) + 1
    weight = lambda t, k: log((seen[k][t] + 1) / (sum(seen[k].values()) + size))
    for x in got:
        want = log((pages["block"] + 1) / (pages["allow"] + 1)) + sum(weight(t, "block") - weight(t, "allow") for t in tokens[x.host, x.path])
        assert x.block_score == pytest.approx(want) and (x.rule or x.verdict == ("block" if want > 0 else "allow"))
    assert any(len(x.host.split(".")[0]) > 8 and len(tokens[x.host, x.path]) > 4 for x in got)


def test_toxicity(spark):
    from lodestrata.llm.toxicity import Field, scored

    texts, labels = {6: None, 7: ""}, []
    for i in range(100, 400):
        w = prose(60, i).split()
        if i % 5 == 0:
            for k in range(1 + i % 3):
                w[rng.randrange(60)] = rng.choice(["grobbles", "grobbling", "snarfy"])
        texts[i] = " ".join(w)
        labels.append((i, 1, int(i % 5 == 0)))
    got = {r.doc_id: r for r in scored(spark, docs(spark, texts), spark.createDataFrame([*labels, (6, 1, None)], "doc_id long, quality int, toxic int")).collect()}
    assert all(got[i].predicted == t for i, _, t in labels) and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in texts)
    assert got[6].predicted == got[7].predicted == 0
    # marginals over gaps equal those of the whole chain, counted over all tag sequences
    import itertools
    import math

    field = Field()
    e = [None, 3.0, None, None, 1.5]
    weights = {}
    for tags in itertools.product((0, 1), repeat=5):
        z = sum((field.bias + (e[i] or 0)) * t for i, t in enumerate(tags)) + sum(field.move[a][b] for a, b in zip(tags, tags[1:], strict=False))
        weights[tags] = math.exp(z)
    for at, m in zip((1, 4), field.marginals([1, 2, 0], [3.0, 1.5]), strict=True):
        assert m == pytest.approx(sum(w for t, w in weights.items() if t[at]) / sum(weights.values()))


def test_bpe(spark):
    P = pytest.importorskip("public_tokenizers")
    import tiktoken

    from lodestrata.llm.bpe_fst import Codec, Utf8Stream, encoded, read_ranks

    ranks = read_ranks(P.path("byte_bpe_50k.tiktoken"))
    own, ref = Codec(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for _ in range(400):
        s = "".join(rng.choice("abcdeeehilnorst  \n'ß漢éü😀1,=-") for _ in range(rng.randrange(80)))
        assert own.encode(s) == ref.encode_ordinary(s) and "".join(own.decode(own.encode(s))) == s
        data = bytes(rng.choice(b"a\xc3\xa4\xf0\x9f\x98\x80\xe0\xff") for _ in range(12))
        stream = Utf8Stream()
        assert "".join([stream.feed(data[i : i + 1]) for i in range(len(data))]) + stream.close() == data.decode("utf-8", "replace")
    for r in encoded(spark, docs(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect():
        text = TEXTS[r.doc_id] or ""
        ids = ref.encode_ordinary(text)
        assert tuple(r)[1:] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    pytest.importorskip("public_tokenizers")
    texts = {i: prose(90, i) for i in range(1, 40)} | {50: prose(90, 3), 51: "short", 52: prose(70, 200) + "\n" + prose(40, 5)[:200]}
    item = prose(30, 300)
    texts[53] = prose(90, 301) + " " + item
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(texts) - {50, 51, 53}
    left = brute_spans({i: t for i, t in texts.items() if i not in (50, 51)})
    assert got[52].decoded_sha256 == left[52][3] and left[52][1] > 0
