import random

from foliospark.llm import language as L

BANK = {
    "en": "the committee has approved all outstanding invoices before end of this quarter without further notice and survey team",
    "de": "die Vergabestelle prüft der Bericht über Trinkwasserqualität und ohne weitere Ankündigung wegen fehlender Unterschriften nach kurzer Anhörung",
    "fr": "le comité des marchés a rejeté les factures impayées pour ensemble du personnel sans autre préavis avant la fin",
    "es": "la oficina de registros ha devuelto el estudio del alcantarillado según informó para todo personal fijo sin previo aviso",
    "pt": "a seção de auditoria prorrogou as folhas presença no ponto para todos os funcionários sem aviso prévio conforme regulamento",
    "ur": "محکمہ آب نے چودہ دن کے اندر دیکھ بھال کے شیڈول کو مسترد کر دیا ہے ضلعی انجینئر",
    "ar": "اعتمد مكتب السجلات بموجب البند سياسة السلامة الجديدة بسبب نقص التوقيعات عدّل فريق الصيانة جميع الفواتير",
}


def text(lang, n, rng):
    w = BANK[lang].split()
    return " ".join(rng.choice(w) for _ in range(n))


def tables(spark):
    rng = random.Random(0)
    pages, labels = [], []
    for i in range(280):
        lang = L.LANGUAGES[i % 7]
        pages.append((i, text(lang, 60, rng)))
        wrong = i % 11 == 0
        labels.append((i, L.LANGUAGES[(i + 1) % 7] if wrong else {"en": "en-GB", "de": "German", "ur": "urd"}.get(lang, lang)))
    labels += [(0, "xx"), (1, None), (None, "en"), (2, "")]
    extra = [(1000, text("en", 60, rng) + ". " + text("de", 60, rng) + ". " + text("en", 60, rng)), (1001, text("ur", 60, rng) + " PDF Form B " + text("ur", 60, rng)), (1002, None), (1003, "  "), (1004, "12 [5]"), (1005, text("fr", 60, rng).encode().decode("latin-1")), (1006, text("es", 30000, rng)), (1007, "der"), (1007, "der")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in pages + extra], "page_id bigint, text string, lang string, seg_no int")
    return df, spark.createDataFrame(labels, "page_id bigint, lang string")


def test_stretches(spark):
    pages, labels = tables(spark)
    got = {}
    for r in L.stretches(pages, labels).orderBy("page_id", "seg_no").collect():
        assert 0 <= r["confidence"] <= 1 + 1e-6 and r["begin"] < r["end"]
        got.setdefault(r["page_id"], []).append(r["lang"])
    assert sum(got[i] == [L.LANGUAGES[i % 7]] for i in range(280)) == 280
    assert got[1000] == ["en", "de", "en"] and got[1001] == ["ur"] and got[1005] == ["fr"] and got[1006] == ["es"] and got[1007] == ["de", "de"]
    assert not {1002, 1003, 1004} & set(got)
    best = {r["page_id"]: r["lang"] for r in L.page_languages(pages, labels).collect()}
    assert best[1000] == "en" and best[1001] == "ur"


def test_empty(spark):
    pages, labels = tables(spark)
    assert L.stretches(pages.filter("false"), labels).count() == 0
    assert L.stretches(pages, labels.filter("false")).filter("page_id < 10").count() == 10


def test_forward_backward_equals_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    n, t = 3, 5
    scores, trans, start = rng.normal(size=(t, 1, n)), rng.normal(size=(n, n)), rng.normal(size=n)
    weight = {p: np.exp(start[p[0]] + sum(scores[i, 0, p[i]] for i in range(t)) + sum(trans[p[i], p[i + 1]] for i in range(t - 1))) for p in itertools.product(range(n), repeat=t)}
    total = sum(weight.values())
    marginal, pair = L.forward_backward(scores, np.array([t]), trans, start, True)
    for i in range(t):
        for k in range(n):
            assert abs(marginal[i, 0, k] - sum(w for p, w in weight.items() if p[i] == k) / total) < 1e-9
    for a in range(n):
        for b in range(n):
            assert abs(pair[a, b] - sum(w * sum(p[i] == a and p[i + 1] == b for i in range(t - 1)) for p, w in weight.items()) / total) < 1e-9
