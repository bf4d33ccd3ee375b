import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridelta.llm import boilerplate as B
from veridelta.llm import boilerplate_train as BT

SF = "/root/testdata/sf0.01"
PAGE = "Home · News · Checks · About\nOn 2018-03-14, Ada Byron was listed as a full member of the Old Club in Port Vale while the board debated the salt road.\n\nHow we checked\n• the seating plan\nThe committee copied the cover letter for the 14 people affected.\nRelated stories\nBob Stone rejected the timeline of decisions\nEve Moss copied a misleading chart (75)\nShare this: Email · Print · Copy link\n© 2024 Birch Dispatch. All rights reserved."
SCHEMA = "ord long, text string, metadata struct<extraction_method:string>"


def test_labels_a_page(spark):
    data = [(1, PAGE, ("html.paragraph_fallback",)), (2, PAGE, None), (3, None, None), (4, "", ("x",)), (5, " \n\t\n", None), (1, PAGE, ("html.paragraph_fallback",))]
    df = spark.createDataFrame(data, SCHEMA).withColumn("_method", F.lit(3)).withColumn("line_no", F.lit(3)).withColumn("probability", F.lit("a"))
    got = {}
    for r in B.furniture_lines(df).collect():
        got.setdefault(r.ord, []).append(r.line_no)
    assert sorted(got[1]) == sorted([1, 7, 8, 9, 10, 11] * 2) and set(got) == {1, 2}
    text = {r.ord: r.content for r in B.main_content(df).collect()}
    assert text[3] is None and text[4] == "" and text[1].startswith("On 2018") and "Related" not in text[1] and "seating plan" in text[1]
    assert B.furniture_lines(df.limit(0)).count() == 0


def test_padding_and_order_do_not_matter():
    """A page's labels don't depend on the pages it is run with."""
    m = B.Model.load()
    pages = [PAGE, "One line only.", PAGE + "\n" + PAGE, "Advertisement", "\n".join(["The committee dated an early draft of the report."] * 300)]
    alone = [B.furniture(B.read_pages([p], [None], B._Places(m.hashes)), m) for p in pages]
    together = B.furniture(B.read_pages(pages, [None] * len(pages), B._Places(m.hashes)), m)
    assert np.allclose(np.concatenate(alone), together, atol=1e-5)


def test_gradient_is_right():
    """The hand-written gradient of the LSTM against finite differences."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5, 3)).astype(np.float32)
    at = np.array([[0, 3], [1, 4], [2, -1]])
    w = (rng.normal(size=(3 + 2 + 1, 8)) * 0.5).astype(np.float32)
    goal = rng.normal(size=(5, 2)).astype(np.float32)
    loss = lambda w_, x_: float((BT._forward(x_, at, w_)[0].astype(float) * goal).sum())
    dw, dx = BT._backward(goal, BT._forward(x, at, w)[1], w, 3)
    for grad, arr, f in ((dw, w, lambda a: loss(a, x)), (dx, x, lambda a: loss(w, a))):
        for idx in [(0, 0), (2, 1), (arr.shape[0] - 1, arr.shape[1] - 1)]:
            up, down = arr.copy(), arr.copy()
            up[idx] += 1e-2
            down[idx] -= 1e-2
            assert grad[idx] == pytest.approx((f(up) - f(down)) / 2e-2, abs=2e-2)


def test_training_learns(monkeypatch):
    """A small fit tells furniture from text on pages it hasn't seen."""
    rng = np.random.default_rng(1)
    pages, labels = [], []
    for k in range(60):
        art = [f"The clerk number {rng.integers(99)} copied the letter again." for _ in range(rng.integers(1, 4))]
        lines = ["Home | News"] + art + ["Related stories"] + [f"Ada read book {rng.integers(99)}" for _ in range(rng.integers(1, 3))]
        pages.append("\n".join(lines))
        labels.append({i + 1: not (0 < i <= len(art)) for i in range(len(lines))})
    m = BT.fit(pages[:50], [None] * 50, labels[:50], epochs=12, batch=16, rate=2e-2)
    assert BT.evaluate(m, pages[50:], [None] * 10, labels[50:])[2] == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="pages aren't here")
def test_held_out_accuracy():
    """The tenth of the pages that the model wasn't fitted on, against the annotation of the whole sample."""
    rows = BT.read_rows("/root/testdata/sf0.1/raw_with_extraction.parquet")
    methods = [(r["metadata"] or {}).get("extraction_method") for r in rows]
    labels = BT.annotate([(r["source"], r["text"], m) for r, m in zip(rows, methods)])
    held = [k for k in range(len(rows)) if k % BT.HELD == 0]
    p, r, _ = BT.evaluate(B.Model.load(), [rows[k]["text"] for k in held], [methods[k] for k in held], [labels[k] for k in held])
    assert p > 0.995 and r > 0.995


# Pages written for this test, in words that the tables don't have; + marks the article's lines.
BY_HAND = [
    ("en", """Start page | Weather | Puzzles | Sign in
+The ferry between the two islands was out of service for nine days in March, the harbour office said on Monday.
+
+Its rudder had been damaged by ice, and the only spare part had to come by road from the mainland.
+A reader's letter had claimed that the ship was sold; the register shows no change of owner.
Read next
Why the lighthouse keeps its old lamp
Bakers ask for longer night hours
Post · Save · Send to a friend
© 2023 Island Courier. All rights reserved."""),
    ("de", """Startseite > Region > Fähre fällt aus
Diese Seite verwendet Cookies. Zustimmen | Ablehnen
+Die Fähre zwischen den beiden Inseln fuhr im März neun Tage lang nicht, teilte das Hafenamt am Montag mit.
+Das Ruder war vom Eis beschädigt worden, und das einzige Ersatzteil musste über die Straße kommen.
Anzeige
+In einem Leserbrief hieß es, das Schiff sei verkauft; im Register steht davon nichts.
Teilen: E-Mail · Drucken · Link kopieren
© 2023 Inselbote. Alle Rechte vorbehalten."""),
    ("fr", """Accueil · Météo · Jeux · Connexion
+Le bac entre les deux îles est resté à quai neuf jours en mars, a indiqué lundi la capitainerie.
+• le gouvernail
+• la pièce de rechange
+Une lettre de lecteur disait le navire vendu ; le registre ne porte aucun changement.
À lire également
Le phare garde sa vieille lampe
Les boulangers veulent travailler plus tard
Partager : courriel · imprimer · copier le lien"""),
    ("zh", """首页 | 天气 | 游戏 | 登录
+港务局周一表示，两岛之间的渡轮三月份停航九天。
+船舵被冰损坏，唯一的备件只能从陆路运来。
+有读者来信称该船已被出售，登记簿上并无变更。
推荐阅读
灯塔保留旧灯的原因
面包师要求延长夜间工作时间
© 2023 海岛信使。版权所有。"""),
]


def test_pages_labelled_by_hand():
    """Against labels that the annotator didn't make, on pages of no table: the words are mostly unknown to the model, so context and form must do."""
    m = B.Model.load()
    right = total = 0
    for _, page in BY_HAND:
        lines = page.split("\n")
        want = [not x.startswith("+") for x in lines]
        text = "\n".join(x.removeprefix("+") for x in lines)
        p = B.read_pages([text], ["html.paragraph_fallback"], B._Places(m.hashes))
        got = {int(n): bool(q >= 0.5) for n, q in zip(p.line, B.furniture(p, m))}
        right += sum(got[n] == want[n - 1] for n in got)
        total += len(got)
    print("by hand", right, "of", total)
    assert right / total >= 0.8


def test_annotation_needs_no_phrases():
    """Made-up furniture in made-up words, told from an equally frequent subhead by where it stands and under which extraction it comes."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("bdfgklmnprstvz")) + rng.choice(list("aeiou")) for _ in range(3))
    sentence = lambda: " ".join(word() for _ in range(9)).capitalize() + "."
    pages, want = [], []
    for k in range(120):
        method = B.METHODS[k % 3]
        lines = [(sentence(), False), ("Zopaki lomu", False), (sentence(), False), ("- ruvo", False), (sentence(), False)]
        if k % 3 == 2 or (k % 3 == 1 and k % 2):
            lines = [("Miru · Teka · Sovo", True), *lines[:3], ("Vufa", True), *lines[3:], ("Dagu semo", True), *((" ".join(word() for _ in range(4)).capitalize(), True) for _ in range(2)), ("Nepo 3 kiro", True)]
        pages.append((f"site_{k % 4}", "\n".join(x for x, _ in lines), method))
        want.append({i + 1: y for i, (_, y) in enumerate(lines)})
    assert BT.annotate(pages) == want
