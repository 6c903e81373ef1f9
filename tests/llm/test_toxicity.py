import random
import zlib

import numpy as np

from touchline.llm import toxicity as m


def frame(spark, n=700):
    rnd = random.Random(3)
    plain = ["".join(rnd.choice("abcdefgéh") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    bad = ["zorg", "zorga", "zorgip", "blim", "blimo"]
    docs, labels = [], []
    for i in range(n):
        toxic = rnd.random() < 0.25
        words = [rnd.choice(plain) for _ in range(rnd.randint(5, 120))]
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        docs.append((i, " ".join(words), "en", "x"))
        labels.append((i, 1, int(toxic), "x"))
    docs += [(9000, None, None, "x"), (9001, "", None, "x"), (None, docs[5][1], None, "x"), (5, docs[5][1], None, "x"), (9002, "quiet words " * 9000 + "zorg blim zorga blimo", None, "x")]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"), {x[0]: x[2] for x in labels}


def test_held_out_accuracy_and_edges(spark):
    docs, labels, truth = frame(spark)
    model = m.fit(docs, labels, ~m.held_out(__import__("pyspark.sql.functions", fromlist=["col"]).col("doc_id")))
    rows = m.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    got = {r["doc_id"]: r["score"] for r in rows}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == bool(truth[i]) for i in held]) > 0.96
    assert got[9000] == got[9001] and got[9000] < 0.5 and got[None] == got[5] and got[9002] >= 0.5
    assert "zorg*" in model["voters"] and "symbols" in model["voters"]


def test_one_class_or_no_labels(spark):
    docs, labels, _ = frame(spark, 60)
    clean = labels.where("toxic = 0")
    assert {r["score"] for r in m.score(docs, m.fit(docs, clean)).collect()} == {0.0}
    assert {r["score"] for r in m.score(docs, m.fit(docs, labels.limit(0))).collect()} == {0.0}
    assert m.score(docs.limit(0), m.fit(docs, labels)).count() == 0


def made(n=6000):
    """Votes of three copies of one voter, another one and noise; the class; labels with errors."""
    rng = np.random.default_rng(0)
    y = rng.random(n) < 0.3
    one = np.where(y, rng.random(n) < 0.8, rng.random(n) < 0.02)
    two = np.where(y, rng.random(n) < 0.6, rng.random(n) < 0.03)
    noise = rng.random(n) < 0.4
    return np.column_stack((one, one, one, two, noise)).astype(np.int8), y, y ^ (rng.random(n) < 0.05)


def halves(label, labelled=3000):
    start, check = np.full(len(label), np.nan), np.full(len(label), np.nan)
    start[: labelled // 2], check[labelled // 2 : labelled] = label[: labelled // 2], label[labelled // 2 : labelled]
    return start, check


def test_label_model_discounts_copies_and_finds_accuracies():
    votes, y, label = made()
    posterior, found = m.label_model(votes, *halves(label))
    assert ((posterior > 0.5) == y).mean() > 0.9
    assert found["weight"][0] < 0.4 and found["weight"][3] > 1.5 * found["weight"][0]
    assert abs(found["fires_if_toxic"][0] - 0.8) < 0.2 and abs(found["fires_if_clean"][4] - 0.4) < 0.05


def test_posteriors_follow_from_votes_alone():
    """Rows with equal votes have equal posteriors whatever their labels, and rows without labels have the same; labels of the checking half choose
    the round only."""
    votes, _, label = made()
    start, check = halves(label)
    posterior, found = m.label_model(votes, start, check)
    for pattern in np.unique(votes, axis=0):
        assert len(np.unique(posterior[(votes == pattern).all(axis=1)])) == 1
    assert ((posterior >= 0.5) != label)[:3000].sum() > 50  # labels that the votes contradict are overruled
    assert found["agreement"] == ((posterior >= 0.5) == label)[1500:3000].mean()


def plain_label_model(votes, start, check, rounds=30):
    """The same rules, row by row and pair by pair."""
    n, k = len(votes), len(votes[0])
    q = {i: float(start[i]) for i in range(n) if not np.isnan(start[i])}
    share, best, loss = sum(q.values()) / len(q), None, np.inf
    for _ in range(rounds):
        total = sum(q.values())
        a = [(sum(q[i] * votes[i][j] for i in q) + 1) / (total + 2) for j in range(k)]
        b = [(sum((1 - q[i]) * votes[i][j] for i in q) + 1) / (len(q) - total + 2) for j in range(k)]
        seen = [[sum(q[i] * (votes[i][x] - a[x]) * (votes[i][y] - a[y]) + (1 - q[i]) * (votes[i][x] - b[x]) * (votes[i][y] - b[y]) for i in q) for y in range(k)] for x in range(k)]
        rho = [[1.0 if x == y else seen[x][y] / (seen[x][x] * seen[y][y]) ** 0.5 for y in range(k)] for x in range(k)]
        weight = [1 / sum(r for r in row if r >= 0.1) for row in rho]
        z = [np.log(share / (1 - share)) + sum(weight[j] * np.log(a[j] / b[j]) for j in range(k) if votes[i][j]) for i in range(n)]
        p = [1 / (1 + np.exp(-x)) for x in z]
        now = -np.mean([np.log((p[i] if check[i] else 1 - p[i]) + 1e-9) for i in range(n) if not np.isnan(check[i])])
        if now >= loss - 1e-6:
            break
        best, loss, q, share = p, now, dict(enumerate(p)), sum(p) / n
    return best


def test_label_model_equals_plain():
    votes, _, label = made(400)
    start, check = halves(label, 300)
    assert np.allclose(m.label_model(votes, start, check)[0], plain_label_model(votes.tolist(), start, check))


def test_label_ties_and_conflicts(spark):
    """Labels that repeat or contradict each other, on rows that repeat: toxic if any says so, and one training row."""
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (None, "d"), (3, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (2, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    rows = {(r["doc_id"], r["text"], r["toxic"]) for r in m.training_rows(docs, labels, __import__("pyspark.sql.functions", fromlist=["lit"]).lit(True), 10).collect()}
    assert rows == {(1, "a", 1), (2, "c", 0), (3, "e", None)}
