import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark.llm import encoding_repair as R

TEXT = "La bibliothèque municipale a reporté l’étude – “déjà” prête à 20 °C, ça va."
URDU = "محکمہ آب نے چودہ دن کے اندر دیکھ بھال کا حکم دیا۔"


def garbled(text: str, encoding: str) -> str:
    return "".join(R._table(encoding)[0][b] for b in text.encode())


@pytest.mark.parametrize("encoding", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1254"])
@pytest.mark.parametrize("text", [TEXT, URDU, f"{TEXT}\n{URDU}"])
def test_round_trip(encoding, text):
    assert R.repair(garbled(text, encoding)) == (text, 1)


def test_nested_and_partial():
    assert R.repair(garbled(garbled(TEXT, "cp1252"), "cp1252")) == (TEXT, 2)
    assert R.repair(f"{TEXT}\n{garbled(TEXT, 'cp1252')}")[0] == f"{TEXT}\n{TEXT}"


@pytest.mark.parametrize("wrong", ["cp1251", "mac_roman", "cp437"])
def test_single_byte_swap(wrong):
    text = "La sección de auditoría podrá modificar el acta, según informó José."
    bad = text.encode("cp1252").decode(wrong)
    assert R.repair(bad) == (text, 1)


@pytest.mark.parametrize("text", ["", "plain", TEXT, URDU, "BÂTIMENT ET GÂCHES", "AVALIAÇÃO DE MANUTENÇÃO", "«workshop» „bona fide“", "CAFÉ” und Ü“", "MÉXICO É”", "5 µm ± 2 °C § 7 © 2021 £5 €6", "a b c", "ﬁle ​x", "Москва и Київ", "naïve Zoë FENINÖ", "إدارة المالية"])
def test_unusual_is_no_case(text):
    assert R.repair(text) == (text, 0)


def test_operator(spark):
    rows = [(1, TEXT, "x"), (2, garbled(TEXT, "cp1252"), "x"), (2, garbled(TEXT, "cp1252"), "x"), (3, None, None), (4, "", "x"), (None, garbled(URDU, "latin-1"), "x"), (5, "Zo� said", "x"), (6, garbled(TEXT, "cp1252") * 3000, "x")]
    df = spark.createDataFrame(rows, "page_id bigint, text string, layers string")
    got = {(r["page_id"], r["layers"], r["lost"]) for r in R.repaired(df).collect()}
    assert got == {(2, 1, 0), (None, 1, 0), (5, 0, 1), (6, 1, 0)}
    assert R.repaired(df).filter("page_id = 2").count() == 2
    every = R.repair_all(df)
    assert every.count() == len(rows) and every.filter(F.col("text") == TEXT).count() == 3
    assert R.repaired(df.filter("false")).count() == 0 == R.repair_all(df.filter("false")).count()


def test_cp1256_alone():
    latin = "the café for Müller in the Straße"
    arabic = "وافقت اللجنة على مشروع الميزانية في الاجتماع السابق"
    russian = "Комиссия одобрила проект бюджета"
    bad = [latin.encode().decode("cp1256"), arabic.encode("cp1256").decode("cp1251"), "one word: caf" + "é".encode().decode("cp1256")]
    assert R.repair_column(pa.array([*bad, russian, arabic])).to_pylist() == [latin, arabic, "one word: café", russian, arabic]
    assert R._swap("ПРОТОКОЛ ЗАСЕДАНИЯ") is None


CLEAN = [
    "The word мир and Größe", "Let π ≈ 3.14 and λ in ℝ, α=0.5", "a │ b ─ c\n│5│6│", "5 Ω resistor 10 µF, 10 μm and ΔT = 3 K", "Zażółć gęślą jaźń. ŻÓŁĆ PÓŁ", "Příliš žluťoučký kůň úpěl ďábelské ódy",
    "Kadın ılık süt içti; İstanbul'da ığdır ağacı", "Η γρήγορη αλεπού πηδά πάνω από τον σκύλο", "Её дом. Він і їжак; В\xa0Москве живёт Ґалаґан.", "שלום עולם", "こんにちは世界、東京です。", "你好，世界。这是一个测试", "안녕하세요 세계", "Tiếng Việt rất đẹp và trình bày ổn",
    "नमस्ते दुनिया", "สวัสดีชาวโลก", "café\xa0» et «\xa0l’été\xa0», l’œuvre d’Éric — “déjà”", "Microsoft™ Müller† (†1990) ‡ naïve co·op col·lecció històric più città", "x² + y³ ≤ z; a∈B, ∀x∃y √2 ∫f(x)dx", "größe»«Straße» „Spaß“ ÜBER Ü“",
    "hiša naša Košice Přišel šel", "emoji 😀👍🏽 ✓ → ★ ☎", "ﬁle ½ cup 20\xa0°C №5 §3", "Ελλάδα in Greece; Москва is Moscow; القاهرة is Cairo", "Łódź, Česká Třebová, Győr, Ålesund, Þingvellir, Đà Nẵng", "the ñ and ü", "ГОСТ 7.1 и А4 формат, ÷ ×5", "Été à Paris, où ? Noël, cœur, Ÿ", "© 2016 ® ™ ¶ • ‣ ·",
]
SCRIPTS = {
    "en": "Zoë’s café — “naïve” £5 at 20 °C", "de": "Die Größe der Straße überrascht Müller", "fr": "La bibliothèque a reporté l’étude déjà prête", "es": "La sección de auditoría podrá mañana", "pt": "A avaliação não está à disposição", "ur": URDU, "ar": "وافقت اللجنة على مشروع الميزانية",
    "hi": "नमस्ते दुनिया, यह एक परीक्षण है", "th": "สวัสดีชาวโลก นี่คือการทดสอบ", "vi": "Tiếng Việt rất đẹp và trình bày ổn", "zh": "你好，世界。这是一个测试", "ja": "こんにちは世界、東京です。", "ko": "안녕하세요 세계 여러분", "he": "שלום עולם וברכה", "el": "Η γρήγορη αλεπού πηδά πάνω από τον σκύλο",
    "tr": "Kadın ılık süt içti; ağaç gölgesi", "ru": "Комиссия одобрила проект бюджета", "pl": "Zażółć gęślą jaźń i żubr", "emoji": "well done 😀👍 → ok",
}


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_of_any_script_stays(text):
    assert R.repair(text) == (text, 0)
    assert R.repair(f"{text}\nplain line\n{URDU}") == (f"{text}\nplain line\n{URDU}", 0)


@pytest.mark.parametrize("encoding", R.LEGACY)
def test_every_script_comes_back_from_every_encoding(encoding):
    for language, text in SCRIPTS.items():
        bad = garbled(text, encoding)
        assert R.repair(bad) == (text, 1), (encoding, language)
        assert R.repair_column(pa.array([None, "plain", bad])).to_pylist() == [None, "plain", text], (encoding, language)


def test_any_number_of_layers():
    text = SCRIPTS["fr"]
    for layers in range(1, 10):
        text = garbled(text, "cp1252")
        assert R.repair(text) == (SCRIPTS["fr"], layers)


@pytest.mark.parametrize(("bad", "good"), [("⌐ 2016 Stendale. All rights reserved.", "© 2016 Stendale. All rights reserved."), ("Nevar Utility ª", "Nevar Utility »"), ("By HΘl Velhamton", "By Hél Velhamton"), ("rose from Ј4 to Ђ69 – a", "rose from £4 to €69 – a"), ("The word мир and Nъria", "The word мир and Núria")])
def test_single_places(bad, good):
    assert R.repair_column(pa.array([bad])).to_pylist() == [good]


def test_suspects_are_all_that_repair_changes():
    rng = random.Random(11)
    pool = [*SCRIPTS.values(), *CLEAN]
    changed = 0
    for _ in range(30000):
        text, kind = rng.choice(pool), rng.randrange(3)
        at = rng.randrange(len(text))
        text = text[at : at + rng.randrange(1, 12)]
        try:
            if kind == 0:
                text = garbled(text, rng.choice(R.LEGACY))
            elif kind == 1:
                wrong, right = rng.choice((*R.SWAPPED, R.ARABIC_AS_CYRILLIC))
                text = text.encode(right).decode(wrong)
            else:
                text = "".join(rng.choice(rng.choice(pool)) for _ in range(rng.randrange(1, 6)))
        except UnicodeError:
            continue
        if R.repair(text)[1]:
            changed += 1
            assert len(R.suspects(pa.array([text]))) == 1, text
    assert changed > 5000
