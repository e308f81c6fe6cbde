import random

from pyspark.sql import functions as F

from docmill.llm import leakage as L

RNG = random.Random(3)
VOCABULARY = ["".join(RNG.choice("bcdfglmnprst") + RNG.choice("aeiou") for _ in range(3)) for _ in range(900)]


def prose(n, rng):
    return [rng.choice(VOCABULARY[:60] if rng.random() < 0.4 else VOCABULARY) for _ in range(n)]


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        a, b = [rng.randrange(6) for _ in range(rng.randint(1, 30))], [rng.randrange(6) for _ in range(rng.randint(0, 40))]
        item = L.Item(1, L.np.array(a, L.np.uint32))
        j0 = rng.randrange(len(a))
        assert L.lcs(item, j0, len(a), b) == brute_lcs(a[j0:], b)


def test_word_ids_do_not_see_form():
    assert list(L.word_ids("Don't STOP, café ﬁne")) == list(L.word_ids("dont stop café\n\nfi­ne")) and len(L.word_ids(None)) == len(L.word_ids(" .")) == 0


def share(item, text):
    return L.repeated_share(L.Item(1, L.word_ids(" ".join(item))), L.word_ids(" ".join(text)))[0]


def test_share_of_planted_parts():
    rng = random.Random(2)
    item, noise = prose(60, rng), prose(200, rng)
    assert share(item, noise[:50] + item + noise[50:]) == 1.0
    assert 0.5 <= share(item, noise[:50] + item[:34] + noise[50:]) < 0.7
    assert share(item, noise[:50] + item[:30] + noise[50:90] + item[30:] + noise[90:]) > 0.95
    assert share(item, noise[:50] + item[10:25] + noise[50:]) < 0.5
    assert share(item, noise + rng.sample(item, 60)) < 0.5
    changed = [w if k % 9 else "zzz" for k, w in enumerate(item)]
    assert share(item, noise[:20] + changed + noise[20:]) > 0.8


def test_no_part_is_crowded_out():
    rng = random.Random(5)
    item, noise = prose(60, rng), prose(30, rng)
    text = sum([[*item[:20], *noise[k % 9 : k % 9 + 11]] for k in range(300)], []) + item[45:]
    assert share(item, text) >= 35 / 60


def test_changed_words_do_not_matter():
    rng = random.Random(7)
    item, noise = prose(60, rng), prose(80, rng)
    third = [w if k % 3 else f"zz{k}" for k, w in enumerate(item)]
    assert 0.6 < share(item, noise + third + noise) < 0.75
    gone = [w for k, w in enumerate(item) if k % 4]
    assert share(item, noise + gone[:30] + noise + gone[30:]) > 0.7


def brute_parts(item, text):
    """Words of the best one or two local alignments, by plain loops."""
    n, m = len(item), len(text)
    cell = [[(0, 0, i, j) for i in range(m + 1)] for j in range(n + 1)]
    ends = []
    for j in range(1, n + 1):
        for i in range(1, m + 1):
            same = item[j - 1] == text[i - 1]
            best = max((cell[j - 1][i - 1][0] + (1 if same else -1), "d"), (cell[j - 1][i][0] - 1, "c"), (cell[j][i - 1][0] - 1, "a"))
            if best[0] >= 0:
                from_ = {"d": cell[j - 1][i - 1], "c": cell[j - 1][i], "a": cell[j][i - 1]}[best[1]]
                cell[j][i] = (best[0], from_[1] + (same and best[1] == "d"), from_[2], from_[3])
                ends.append((cell[j][i][1], cell[j][i][2], i, cell[j][i][3], j))
    top = max((e[0] for e in ends), default=0)
    return max([top] + [p[0] + q[0] for p in ends for q in ends if p[2] <= q[1] and p[4] <= q[3]])


def test_parts_against_plain_loops(monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(L, "CELLS", 300)  # many pieces
    monkeypatch.setattr(L, "ANSWERED", 0)
    monkeypatch.setattr(L, "SHARE", 0)
    for _ in range(60):
        item, text = [rng.randrange(8) for _ in range(rng.randint(3, 9))], [rng.randrange(8) for _ in range(rng.randint(0, 90))]
        got, _ = L.repeated_share(L.Item(1, L.np.array(item, L.np.uint32)), L.np.array(text, L.np.uint32))
        assert abs(got * len(item) - brute_parts(item, text)) <= 1  # equal gains may keep different words


def test_templates_with_other_words_are_no_leak():
    item = "doses above nine need a allergy timeline and a second controller to isolate it it is the identity that matters here the workflow does not download anything unless the prescriber objects".split()
    text = "doses above two need a vendor margin and a second analyst to defer it it is the ward that matters here the intake does not sort anything unless the auditor objects".split()
    common = set(item) & set(text)
    idf = L.np.full(L.BUCKETS, 5.0)
    idf[[w & (L.BUCKETS - 1) for w in L.word_ids(" ".join(common)).tolist()]] = 0.5
    assert L.repeated_share(L.Item(1, L.word_ids(" ".join(item))), L.word_ids(" ".join(text)))[0] > 0.5
    assert L.repeated_share(L.Item(1, L.word_ids(" ".join(item)), idf), L.word_ids(" ".join(text)))[0] == 0


def test_operator_finds_what_brute_force_finds(spark):
    rng = random.Random(4)
    items = [(i, " ".join(prose(rng.randint(40, 70), rng))) for i in range(30)]
    docs, planted = [], set()
    for d in range(400):
        words = prose(rng.randint(30, 300), rng)
        if d % 4 == 0:
            i = rng.randrange(30)
            w = items[i][1].split()
            keep = int(len(w) * rng.choice([0.3, 0.65, 0.8, 1.0]))
            at, start = rng.randrange(len(words)), rng.randrange(len(w) - keep + 1)
            words[at:at] = w[start : start + keep]
            if keep >= 0.6 * len(w):
                planted.add((d, i))
        docs.append((d, " ".join(words).title() if d % 3 else " ".join(words)))
    got = {(r["doc_id"], r["item_id"]) for r in L.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text").collect()}
    assert got >= planted
    exact = {(d, i) for d, t in docs for i, x in items if share(x.split(), t.split()) >= L.SHARE}
    assert got <= exact and len(got) >= 0.99 * len(exact)


def test_operator_defined_cases(spark):
    rng = random.Random(6)
    text = " ".join(prose(50, rng))
    docs = [(1, text), (1, text), (2, None), (3, ""), (4, " ... "), (5, " ".join(prose(60_000, rng)) + " " + text), (None, text), (6, "one two")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("share", F.lit(1)).withColumn("item_id", F.lit(1))
    items = spark.createDataFrame([(7, text), (7, text), (8, None), (9, ""), (10, "one two"), (None, text)], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in L.leaked_items(df, "doc_id", "text", items, "item_id", "text").collect())
    assert got == [(1, 7), (5, 7)]
    assert L.leaked_items(df.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert L.leaked_items(df, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0
