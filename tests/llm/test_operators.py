"""The corpus operators against brute force, on a small table with nulls, empty and long texts, copies and clashing columns."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from hearsay.llm import bpe, decontaminate, langid, line_dedup, lm_score, ngram_join, quality, secret_scan, shards, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, h1 string, block string, n_lines string"


def corpus():
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abdeginorstuü") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, line = text(30), text(8)
    base = [text(rng.randint(60, 160)) for _ in range(25)]
    near = [re.sub(r"^\S+", f"w{k}", base[0]) for k in range(30)]
    out = [None, "", " \n\t", "a", "a b", "A b", "\n\n", "x" * 49, *base, *base[:5], base[0].upper(), *near]
    out += [f"{text(50)}\n{line}\n{passage}\n{text(20)}" for _ in range(12)]
    out += [text(12000), f'{text(60)} token = "{"ab12" * 8}" api_key:short secret=abcdefgh AKIA{"Z9" * 9}', "\x00\x00" * 40, "aaaa " * 60]
    return out


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(corpus()))


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(i, t, (None, "de", "en")[i % 3], "s", len(t or ""), "i", "h", "b", "n") for i, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df):
    return {r["doc_id"]: r for r in df.collect()}


def sha(b):
    return hashlib.sha256(b).hexdigest()


def words(t):
    return (t or "").encode().lower().split()


def test_bpe(docs, rows):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.default_ranks().splitlines())}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: enc.encode_ordinary(t or "") for i, t in rows}
    whole, cut = got(bpe.report(docs)), got(bpe.encode(docs, chunk_chars=70, overlap_chars=20))
    for i, t in rows:
        assert (whole[i].n_tokens, whole[i].ids_sha256, whole[i].decoded_sha256) == (len(want[i]), sha(" ".join(map(str, want[i])).encode()), sha((t or "").encode()))
        assert cut[i].ids == want[i]


def brute_components(rows, k, pct):
    def shingles(t):
        w = words(t)
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())

    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= pct * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sets, {i: find(i) for i in sets}


@pytest.mark.parametrize("k,pct", [(4, 85), (5, 80)])
def test_ngram_join(docs, rows, k, pct):
    sets, comp = brute_components(rows, k, pct)
    out = got(ngram_join.near_duplicates(docs, words=k, percent=pct))
    assert {i: (r.n_shingles, r.component_id) for i, r in out.items()} == {i: (len(sets[i]), comp[i]) for i in sets}


def test_ngram_join_blocks(docs, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "ROWS", 4)
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 5000)
    _, comp = brute_components(rows, 4, 85)
    assert {i: r.component_id for i, r in got(ngram_join.report(docs)).items()} == comp


@pytest.mark.parametrize("pct", [60, 75, 80, 85, 95])
def test_linked_sets_share_a_gathering_key(pct):
    """Linked sets of all sizes, differing at random places, at the front, or evenly."""
    rng = np.random.default_rng(pct)
    linked = 0
    for trial in range(3000):
        n = int(rng.integers(1, 120))
        order = np.sort(rng.choice(10**6, n, replace=False)).astype(np.uint64)
        most = n * (100 - pct) // 100
        for gone in (rng.choice(n, most, replace=False), np.arange(most), np.arange(most) * (n // max(1, most)), np.arange(most) * min(3, n // max(1, most))):
            side = rng.integers(0, 2, len(gone)).astype(bool) if trial % 2 else np.zeros(len(gone), bool)
            x, y = np.delete(order, gone[side]), np.delete(order, gone[~side])
            both = len(np.intersect1d(x, y))
            if both and 100 * both >= pct * len(np.union1d(x, y)):
                linked += 1
                a, b = (ngram_join.gathering_keys(s, np.ones(len(s), bool), pct) for s in (x, y))
                assert np.intersect1d(a, b).size
    assert linked > 3000


def linked_pairs(pct, seed):
    """Linked pairs of sets of 1 to 300 columns, small ones more often, as the sorted columns of both."""
    rng = np.random.default_rng(seed)
    yield np.arange(7, dtype=np.uint64), np.array([0, 1, 2, 3, 5, 6], np.uint64)
    for _ in range(6000):
        n = int(rng.integers(1, rng.choice([8, 20, 60, 301])))
        order = np.sort(rng.choice(10**6, n, replace=False)).astype(np.uint64)
        gone = rng.choice(n, n * (100 - pct) // 100, replace=False)
        side = rng.random(len(gone)) < rng.random()
        x, y = np.delete(order, gone[side]), np.delete(order, gone[~side])
        if 100 * len(np.intersect1d(x, y)) >= pct * len(np.union1d(x, y)) > 0 and len(x) != len(np.intersect1d(x, y)):
            yield x, y


@pytest.mark.parametrize("pct", [80, 85])
def test_linked_pairs_share_a_key_with_their_own_marks(pct):
    """Marks as of two rows alone: a column is marked if it is in the other's prefix. Some columns are frequent, and come last."""
    rng, seen = np.random.default_rng(1), 0
    for x, y in linked_pairs(pct, pct):
        frequent = np.sort(rng.choice(x, int(len(x) * rng.choice([0, 0.1, 0.5])), replace=False))
        prefixes = [s[: ngram_join.prefix_length(len(s), pct)] for s in (x, y)]
        keys = []
        for s, own, other in zip((x, y), prefixes, prefixes[::-1]):
            shared = ngram_join.may_be_shared(np.isin(own, other), len(s), pct)
            order = np.argsort(np.isin(s, frequent), kind="stable")
            keys.append(ngram_join.gathering_keys(s[order], shared[order], pct))
        assert np.intersect1d(*keys).size, (x, y)
        seen += 1
    assert seen > 2000


@pytest.mark.parametrize("pct", [60, 80, 85, 95])
def test_linked_pairs_stay(pct):
    """Of two linked rows alone, neither goes: for all sizes, with the columns of one only first."""
    for n in range(1, 120):
        for m in range(n, n * 100 // pct + 1):
            both = -(-pct * (n + m) // (100 + pct))
            x = np.concatenate([np.arange(n - both), np.arange(500, 500 + both)])
            y = np.concatenate([np.arange(200, 200 + m - both), np.arange(500, 500 + both)])
            p, q = (s[: ngram_join.prefix_length(len(s), pct)] for s in (x, y))
            shared = len(np.intersect1d(p, q))
            assert shared >= max(ngram_join.common_in_prefixes(k, pct) for k in (n, m)), (n, m)


def test_ngram_join_short_texts(spark):
    """Pairs of 8 and 9 words alone, one a prefix or suffix of the other."""
    data = []
    for k in range(60):
        w = [f"{hashlib.md5(b'%d-%d' % (k, j)).hexdigest()[: 3 + (j * 7 + k) % 6]}" for j in range(9)]
        data += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[:8] if k % 2 else w[1:]))]
    out = got(ngram_join.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), words=5, percent=80))
    assert {i: r.component_id for i, r in out.items()} == {i: i - i % 2 for i, _ in data}


def test_quality(docs, rows):
    out = got(quality.report(docs))
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, at = collections.Counter(zip(w, w[1:], w[2:])), set()
        for j in range(len(w) - 2):
            if seen[tuple(w[j : j + 3])] > 1:
                at |= {j, j + 1, j + 2}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(at))
        assert r.base_failed == (len(w) < 50 or 100 * len(at) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_quality_rejects_word_salad(spark):
    """300 random words of lower-case letters, some with '#', fail; text with its language's common words stays, in any case."""
    rng, data = random.Random(3), []
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    for lang, common in quality.COMMON_WORDS.items():
        for k in range(30):
            w = [rng.choice(common) if rng.random() < (0.1, 0.25, 0.4)[k % 3] else word() for _ in range(300)]
            data.append((len(data), " ".join(w).title() if k % 5 == 4 else " ".join(w), lang, True))
    for k in range(12):
        data.append((len(data), " ".join(word() + ("#" if k % 2 and rng.random() < 0.1 else "") for _ in range(300)), (None, "en")[k % 2], False))
    out = got(quality.report(spark.createDataFrame([d[:3] for d in data], "doc_id long, text string, lang string")))
    title = {d[0] for d in data if d[1].istitle()}  # capitals are judged by the characters' rule
    assert {d[0] for d in data if d[0] not in title and out[d[0]].kept != d[3]} == set()
    plain = [out[d[0]].word_distance for d in data if d[3] and d[0] not in title]
    assert max(out[i].word_distance for i in title) <= max(plain) + 0.02


PROSE = {
    "pl": """Wczoraj rano poszedłem do sklepu, żeby kupić chleb i mleko, ale okazało się, że sklep był zamknięty. Postanowiłem więc pójść na
        rynek, gdzie zawsze jest dużo ludzi i można kupić świeże warzywa. Na rynku spotkałem sąsiada, który powiedział mi, że w mieście będzie
        nowy park i że prace mają się zacząć już w przyszłym miesiącu. Rozmawialiśmy o tym przez chwilę, a potem wróciłem do domu. W domu
        zrobiłem śniadanie i napisałem list do siostry, która mieszka w innym mieście. Napisałem jej, że u nas wszystko jest w porządku.""",
    "sv": """I går gick jag till affären för att köpa bröd och mjölk, men det visade sig att affären var stängd. Jag bestämde mig därför för
        att gå till torget, där det alltid finns många människor och där man kan köpa färska grönsaker. På torget träffade jag min granne, som
        berättade att staden ska bygga en ny park och att arbetet ska börja redan nästa månad. Vi pratade om det en stund och sedan gick jag
        hem igen. Hemma lagade jag frukost och skrev ett brev till min syster, som bor i en annan stad, och berättade att allt är bra.""",
    "ru": """Вчера утром я пошёл в магазин, чтобы купить хлеб и молоко, но оказалось, что магазин закрыт. Поэтому я решил пойти на рынок, где
        всегда много людей и где можно купить свежие овощи. На рынке я встретил соседа, который сказал мне, что в городе будет новый парк и что
        работы должны начаться уже в следующем месяце. Мы поговорили об этом немного, а потом я вернулся домой. Дома я приготовил завтрак и
        написал письмо сестре, которая живёт в другом городе. Я написал ей, что у нас всё в порядке и что мы ждём её приезда.""",
    "it": """Ieri mattina sono andato al negozio per comprare il pane e il latte, ma ho scoperto che il negozio era chiuso. Ho deciso quindi di
        andare al mercato, dove c'è sempre molta gente e dove si può comprare la verdura fresca. Al mercato ho incontrato il mio vicino, che mi
        ha detto che la città costruirà un nuovo parco e che i lavori cominceranno già il mese prossimo. Ne abbiamo parlato per un po' e poi
        sono tornato a casa. A casa ho preparato la colazione e ho scritto una lettera a mia sorella, che vive in un'altra città.""",
}


def brute_quality(rows):
    """kept by a plain Jensen-Shannon distance, per row (id, text, lang)."""
    import unicodedata

    def hists(t):
        c = collections.Counter()
        for ch in t:
            kind = unicodedata.category(ch)
            c["lower" if kind in ("Ll", "Lo") else "upper" if kind == "Lu" else "digit" if ch in "0123456789" else "space" if ch in " \t\n\x0b\x0c\r" else "stop" if ch in ".,;:!?'\"()-" else "rest"] += 1
        w = [x.lower() for x in t.split()]
        n = {k: sum(x in v for x in w) for k, v in quality.COMMON_WORDS.items()}
        return c, {**n, "rest": max(0, len(w) - sum(n.values()))}, w

    def distance(p, q):
        sp, sq, out = sum(p.values()), sum(q.values()), 0.0
        for k in {*p, *q}:
            a, b = p.get(k, 0) / max(sp, 1), q.get(k, 0) / max(sq, 1)
            out += (a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0)
        return math.sqrt(max(out / 2, 0))

    refs = {lang: [collections.Counter(), collections.Counter()] for lang in quality.COMMON_WORDS}
    base = {}
    for i, t, lang in rows:
        c, h, w = hists(t)
        seen, at = collections.Counter(zip(t.split(), t.split()[1:], t.split()[2:])), set()
        for j, g in enumerate(zip(t.split(), t.split()[1:], t.split()[2:])):
            at |= {j, j + 1, j + 2} if seen[g] > 1 else set()
        base[i] = len(w) < 50 or 100 * len(at) > 50 * len(w)
        if lang in refs and not base[i]:
            refs[lang][0].update(c)
            refs[lang][1].update(h)
    refs = {k: v for k, v in refs.items() if sum(v[0].values())}
    out = {}
    for i, t, _ in rows:
        c, h, w = hists(t)
        odd = len(t) >= 200 and min(distance(c, r[0]) for r in refs.values()) > quality.MAX_CHAR_DISTANCE
        over = min(distance(h, r[1]) - quality.MAX_WORD_SHARE * distance({"rest": 1}, r[1]) for r in refs.values())
        own = [x for x in w if any(ch.isalpha() for ch in x) or len(x) > 3]
        out[i] = not base[i] and not odd and not (len(w) >= 80 and over > 0 and 1 - len(set(own)) / max(1, len(own)) < quality.MIN_REUSE)
    return out


def test_quality_keeps_prose_of_other_languages(spark):
    rng, data = random.Random(5), []
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    for lang, common in quality.COMMON_WORDS.items():
        data += [(len(data) + k, " ".join(rng.choice(common) if rng.random() < 0.3 else word() for _ in range(200)), lang) for k in range(12)]
    prose = {len(data) + k: lang for k, lang in enumerate([*PROSE, *PROSE])}
    data += [(i, " ".join(PROSE[lang].split()), lang if k < 4 else None) for k, (i, lang) in enumerate(prose.items())]
    salad = range(len(data), len(data) + 8)
    data += [(i, " | ".join(word() for _ in range(150)) if i % 2 else " ".join(word() for _ in range(250)), (None, "en")[i % 2]) for i in salad]
    data += [(len(data), " ".join(word() + "&&&" for _ in range(120)), "en"), (len(data) + 1, "a b c", "en")]
    out = got(quality.report(spark.createDataFrame(data, "doc_id long, text string, lang string")))
    assert all(out[i].kept for i in prose) and not any(out[i].kept for i in salad)
    assert {i: r.kept for i, r in out.items()} == brute_quality(data)


def test_secrets(docs, rows):
    out = got(secret_scan.report(docs))
    for i, t in rows:
        t = t or ""
        s = [(m.start(), 0, m.end()) for m in secret_scan.ASSIGN.finditer(t) if len(m[2]) >= 6]
        s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        s += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert out[i].base_sha256 == sha(secret_scan.joined(sorted(s)).encode())
        assert set(secret_scan.joined(sorted(s)).split(",")) - {""} <= set(out[i].spans.split(","))


def test_network_finds_secrets_without_a_base_pattern(spark):
    """Trained on labelled findings of its own table, it finds tokens of other shapes and leaves identifiers, paths, names and numbers alone."""
    import string

    rng = random.Random(7)
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    hexa, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    vocab = ["".join(rng.choice(["ver", "la", "ment", "tion", "ing", "er", "qua", "so", "re", "th", "en", "ou", "st", "be"]) for _ in range(rng.randint(1, 4))) for _ in range(600)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    label = [lambda: f'api_key = "{draw(alnum, 32)}"', lambda: f"password: {draw(alnum, 14)}", lambda: "AKIA" + draw(string.ascii_uppercase + string.digits, 16), lambda: draw(hexa, 40)]
    texts = [f"{prose(60)} {rng.choice(label)()} {prose(60)}" if k < 60 else prose(150) for k in range(300)]
    secret = {
        "ghp": lambda: "ghp_" + draw(alnum, 36), "live": lambda: "sk_live_" + draw(alnum, 24), "base64": lambda: draw(alnum + "+/", 40), "url": lambda: draw(alnum + "-_", 43),
        "letters": lambda: draw(string.ascii_lowercase, 32), "upper": lambda: draw(string.ascii_uppercase + string.digits, 24), "mixed": lambda: draw(alnum, 20),
    }
    ordinary = {
        "snake": lambda: "_".join(rng.choices(vocab, k=4)), "path": lambda: "usr/local/" + "/".join(rng.choices(vocab, k=3)), "camel": lambda: "".join(w.title() for w in rng.choices(vocab, k=4)),
        "image": lambda: f"IMG_2024{rng.randrange(10**4):04d}_{rng.randrange(10**6):06d}", "number": lambda: draw(string.digits, 16), "slug": lambda: "-".join(rng.choices(vocab, k=3)) + "-2023",
    }
    planted = []
    for kinds in (secret, ordinary):
        for name, make in kinds.items():
            for _ in range(25):
                head, body = prose(30), make()
                planted.append((name, kinds is secret, len(head) + 1, len(head) + 1 + len(body)))
                texts.append(f"{head} {body} {prose(30)}")
    out = got(secret_scan.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    hits = collections.Counter()
    for i, (name, _, a, e) in enumerate(planted, 300):
        spans = [x.split(":") for x in out[i].spans.split(",") if x]
        hits[name] += any(k in ("net", "hex") and int(s) < e and a < int(t) for k, s, t in spans)
    assert sum(hits[n] for n in secret) >= 0.9 * 25 * len(secret) and all(hits[n] >= 18 for n in secret), hits
    assert sum(hits[n] for n in ordinary) <= 0.05 * 25 * len(ordinary), hits
    assert sum(out[i].n_net for i in range(60, 300)) == 0


def test_network_learns_from_every_finding_and_word(spark):
    """No finding, word or number of a text is left out of the training, however many lie in one text; partitions don't matter."""
    import string

    rng = random.Random(8)
    draw = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))
    vocab = ["".join(rng.choice(["ver", "la", "ment", "tion", "qua", "so"]) for _ in range(rng.randint(1, 4))) for _ in range(150)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    secrets = [[draw(24) for _ in range(n)] for n in (40, 40, 0, 0, 0)]
    numbers = [str(rng.randrange(10**13, 10**14)) for _ in range(9)]
    texts = [" ".join(f"{prose(20)} token = {s} {prose(5)}" for s in own) or prose(200) for own in secrets]
    texts += [f"rareword {' '.join(numbers)} {prose(30)} ghp_{draw(36)} {prose(30)}", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = secret_scan.findings(docs.repartition(3), "text").collect()
    of = lambda kind: {r["body"] for r in found if r["kind"] == kind}
    assert of("secret") == {s for own in secrets for s in own} and of("number") == set(numbers)
    assert of("word") == {w for t in texts for w in (t or "").split() if w in vocab and len(w) > 2} | {"rareword"}
    few = [r for r in found if r["kind"] in ("context", "number")] + [("word", None, f"word{c}", None) for c in string.ascii_lowercase] + [("secret", "a ", "Zz9" * 99, " b")]
    x, y, _ = secret_scan.examples(few, False, 1)
    held = [bytes(w) for w in x]
    assert all(any(n.encode() in w for w in held) for n in numbers) and all(any(f"word{c}".encode() in w.lower() for w in held) for c in string.ascii_lowercase)
    assert any(w[20:53] == b"Zz9" * 11 and w.endswith(b" b" + b"\0" * 6) for w in held)  # the end of a long one
    one, other = (got(secret_scan.report(docs.repartition(n))) for n in (1, 4))
    assert one == other and one[5].n_net == 1


def test_suffix_dedup(docs, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 20000)
    out, seen = got(suffix_dedup.report(docs)), set()
    for i, t in rows:
        b = (t or "").encode()
        own = [b[p : p + 50] for p in range(len(b) - 49)]
        gone = bytearray(len(b))
        for p, s in enumerate(own):
            if s in seen:
                gone[p : p + 50] = b"\1" * 50
        seen.update(own)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        assert (out[i].n_bytes, out[i].n_removed, out[i].n_spans, out[i].kept_sha256) == (len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), sha(kept))


def test_language_id_accuracy_on_held_out_rows(spark):
    """Every language of the table is learned, however many there are; held-out rows of each are recognised."""
    rng, data = random.Random(6), []
    langs = [f"l{k:02d}" for k in range(70)]
    syllables = {lang: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöüéèñç") for _ in range(3)) for _ in range(12)] for lang in langs[:8]}
    for lang in langs[:8]:
        for _ in range(120):
            data.append((len(data), " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(20, 80))), lang))
    for lang in langs[8:]:
        data += [(len(data) + k, f"{lang} only a few rows", lang) for k in range(2)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    assert {s[0] for s in langid.training_sample(docs, "doc_id", "text", "lang")} >= set(langs[:8]) and len({s[0] for s in langid.training_sample(docs, "doc_id", "text", "lang")}) > 64
    out = got(langid.report(docs.filter("doc_id < 960")))
    right, seen = collections.Counter(), collections.Counter()
    for i, _, lang in data[:960]:
        if out[i].held_out:
            seen[lang] += 1
            right[lang] += out[i].lang_pred == lang
    assert len(seen) == 8 and all(right[k] >= 0.9 * seen[k] for k in seen), (right, seen)


def test_language_id(docs, rows):
    out = got(langid.report(docs))
    for i, t in rows:
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert (out[i].lang_pred == "und") == (not t or not any(c.isalpha() for c in t)) and 0 <= out[i].score <= 1


def test_sharding(docs, rows):
    out = got(shards.report(docs))
    slots, load = collections.defaultdict(set), collections.Counter()
    for i, t in rows:
        b = (t or "").encode()
        assert (out[i]["size"], out[i].text_crc32) == (len(b) + 1, zlib.crc32(b))
        slots[out[i].shard].add(out[i].slot)
        load[out[i].shard] += out[i]["size"]
    assert all(s == set(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    assert max(load.values()) - min(load.get(k, 0) for k in range(8)) <= max(len((t or "").encode()) + 1 for _, t in rows)  # law: bytes
    grown = shards.rebalance(shards.rebalance([k % 8 for k in range(64)], list(range(64)), 8), list(range(64)), 9, only_into=8)
    before = shards.rebalance([k % 8 for k in range(64)], list(range(64)), 8)
    assert all(a == b or b == 8 for a, b in zip(before, grown)) and 8 in grown


def test_decontamination(spark, docs, rows):
    item = rows[-6][1].split("\n")[2]
    bench = spark.createDataFrame([(1, item.upper()), (2, "never seen words of an item that no text has at all"), (3, None), (4, " ")], "item_id long, text string")
    out = got(decontaminate.report(docs, bench))
    assert {i for i, r in out.items() if r.contaminated} == {i for i, t in rows if t and item.lower() in t.lower()}
    index = decontaminate.Index([(k, " ".join(random.Random(k).choices("abcdefghij", k=12))) for k in range(90)])
    for seed in range(40):
        terms = random.Random(seed).sample(range(10), 4)
        score = collections.Counter()
        for t in terms:
            for at, x in zip(index.items[t], index.impacts[t]):
                score[at] += x
        assert sorted(k for k, _ in index.search(terms, 0.45)) == sorted(k for k, v in score.items() if v >= 0.45 - 1e-9)


def test_decontamination_of_edited_items():
    """Items of 15 to 59 words, in a text, with a word changed at each place or two anywhere; the question alone; other texts."""
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abdeginorstu") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    common = vocab[:40]
    text = lambda n: [rng.choice(common if rng.random() < 0.4 else vocab) for _ in range(n)]
    items = [text(rng.randint(15, 59)) for _ in range(60)]
    index = decontaminate.Index([(k, " ".join(w)) for k, w in enumerate(items)])
    once = [(k, [j]) for k, w in enumerate(items) for j in range(len(w))]
    twice = [(k, rng.sample(range(len(w)), 2)) for k, w in enumerate(items) for _ in range(20)]
    recall = []
    for edits in (once, twice):
        texts = [" ".join([*text(150), *("other" if j in at else w for j, w in enumerate(items[k])), *text(70)]) for k, at in edits]
        recall.append(sum(k in found for (k, _), found in zip(edits, index.hits(texts))) / len(edits))
    assert recall[0] == 1 and recall[1] > 0.99
    questions = [" ".join([*text(90), *w[: len(w) - len(w) // 4], *text(90)]) for w in items]
    assert sum(k in found for k, found in enumerate(index.hits(questions))) <= 0.05 * len(items)  # without its answer it's clean
    shuffled = [" ".join([*text(90), *rng.sample(w, len(w)), *text(90)]) for w in items]
    assert not any(index.hits(shuffled)) and not any(index.hits([" ".join(text(300)) for _ in range(300)]))
    short = decontaminate.Index([(1, "one short item here")])
    assert [len(h) for h in short.hits(["a one short item here b", "one short other item here"])] == [1, 0]


def test_decontamination_in_parts_gives_the_same_hits(spark, monkeypatch):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abdeginorstu") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [text(rng.randint(9, 40)) for _ in range(40)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(90, " "), (91, None)], "item_id long, text string")
    edited = [" ".join([*text(60), *(rng.choice(vocab) if rng.random() < 0.3 else w for w in items[k % 40]), *text(60)]) for k in range(120)]
    docs = spark.createDataFrame(list(enumerate(edited)), "doc_id long, text string")
    want = {r.doc_id: r.hits for r in decontaminate.search_documents(docs, bench).collect()}
    assert sum(bool(h) for h in want.values()) > 10
    monkeypatch.setattr(decontaminate, "PART_ITEMS", 11)
    assert {r.doc_id: r.hits for r in decontaminate.search_documents(docs, bench).collect()} == want


def test_lm_score(docs, rows):
    out = got(lm_score.report(docs))
    learn = {i: zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows}
    c = collections.Counter(w for i, t in rows if learn[i] for w in [*words(t), b""])
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        w = [*words(t), b""]
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not learn[i], len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(base) and r.score < 0


def test_line_dedup(docs, rows):
    keys, held = lambda x: x.encode().strip(b" \t\n\x0b\x0c\r").lower().decode(), collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(keys(x)) >= 20:
                held[keys(x)].add(i)
    out = got(line_dedup.report(docs))
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held[keys(x)]) < 3 or max(held[keys(x)]) == i]
        assert (out[i].n_lines, out[i].n_dropped, out[i].kept_sha256) == (len(lines), len(lines) - len(kept), sha("\n".join(kept).encode()))


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([(1, "some words of an item")], "item_id long, text string")
    for f in (bpe, line_dedup, quality, secret_scan, shards, langid, lm_score, ngram_join, suffix_dedup):
        assert f.report(empty).count() == 0, f.__name__
    assert decontaminate.report(empty, bench).count() == 0


def test_pipeline(spark, rows, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, rows[-6][1].split("\n")[2])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    x = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        x = stage(spark, x, str(tmp_path)).cache()
        assert x.columns == docs.columns
    out = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert out == {r["doc_id"] for r in x.collect()} and len(out) >= 20
