"""Small frames with every odd case, and brute-force versions of what the operators compute."""

import itertools

SF = "/root/testdata/sf0.001"

SENTENCE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from the old house", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, " \t\n ", "en", None),
    (5, "12345 %% 99", None, "b"),
    (6, SENTENCE, "en", "b"),
    (7, SENTENCE, "en", "b"),  # equal text
    (7, SENTENCE, "en", "b"),  # repeated row
    (8, SENTENCE + " seventeen", "en", "b"),
    (9, "der die das und nicht ein eine mit von zu " * 8, "de", "a"),
    (10, "line one here\nline one here\nother line\n\nline one here", "en", "a"),
    (None, SENTENCE, "en", "b"),
    (12, "x" * 300_000, "en", "a"),
    (13, "ab cd " * 20_000, "fr", "a"),
    (14, "日本語 テスト <|endoftext|> ½ ² \x1c🎉", "en", "a"),
    (-5, "negative id text with several plain words in it", "en", "a"),
]


def frame(spark, rows=ROWS, extra=True):
    """documents with columns whose names clash with the operators' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    data = [(*r, None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(data, schema)
    if extra:
        for name in ("doc", "kept", "shard", "class_id", "key", "block", "t", "w", "m", "node", "band", "copy", "range", "piece", "score", "length"):
            df = df.selectExpr("*", f"'clash' AS `{name}`")
    return df


def empty(spark):
    return frame(spark, []).limit(0)


def shingles(text, size=5):
    w = (text or "").split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def near_classes(docs, threshold=0.8):
    """{doc_id: class} and {doc_id: linked other texts} by comparing all pairs that share a shingle."""
    text = {d: t for d, t in docs if d is not None}
    sets = {d: shingles(t) for d, t in text.items()}
    by = {}
    for d, s in sets.items():
        for g in s or ([("=", text[d])] if text[d] is not None else []):
            by.setdefault(g, []).append(d)
    parent = {d: d for d in text}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = {d: set() for d in text}
    for a, b in {p for l in by.values() for p in itertools.combinations(sorted(l), 2)}:
        x, y = sets[a], sets[b]
        common = len(x & y)
        if text[a] == text[b] or (x and common >= threshold * (len(x) + len(y) - common) - 1e-9):
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
            if text[a] != text[b]:
                links[a].add(text[b])
                links[b].add(text[a])
    return {d: root(d) for d in text}, {d: len(s) for d, s in links.items()}
