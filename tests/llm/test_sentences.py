import random

import pytest

from pricelens.llm.sentences import ChainModel, cut, places, split_sentences, train

SENTENCES = [
    "Esperé media hora... y no llegó nadie.", "«¡Se agotó!» gritaron desde la fila.", 'El gerente dijo: "No habrá alzas. Lo prometo." y cerró la reunión.', "Vendieron harina, té, café, etc. a mitad de precio.",
    "La empresa Picimere S.A. despacha a Av. Los Zakeri N.º 68, piso 3.", "El formato de 900 cc rinde más, p. ej., para 4 personas.", "EE. UU. exporta menos polenta desde agosto.", "J. M. Logivi firmó el acta.",
    "La tienda abre a las 6.30 hrs. de lunes a sábado.", "(El stock se repone cada 4 días.)", "¿Qué pasó con el despacho?!", "No lo compren!!!", "Gracias por la ayuda :)", "Llegó todo en perfecto estado 👍.", "Pagué $2.850 por 500 g.",
    "Mr. Sipano and Mrs. Vinegaz compared 31 baskets in approx. 3 hours.", "The store closes at 9 p.m. on Sundays.", "Todo lo compra Jolamosa Ltda.",
]


def join(parts, rng):
    text, spans = "", []
    for s in parts:
        text += rng.choice([" ", " ", "  ", "\n\n"]) if text else ""
        spans.append((len(text), len(text) + len(s)))
        text += s
    return text, spans


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    latin = [join(rng.choices(SENTENCES, k=8), rng)[0] for _ in range(200)]
    chinese = ["".join(rng.choices(["太贵了！", "我买了米、面、油等等。", "你知道哪家超市更便宜吗？", "送货花了8天。"], k=6)) for _ in range(120)]
    return train(latin + chinese)


def test_held_out_texts(model):
    rng = random.Random(2)
    right = wanted = found = 0
    for _ in range(120):
        text, spans = join(rng.choices(SENTENCES, k=10), rng)
        got = cut(text, *model)
        right, wanted, found = right + len(set(got) & set(spans)), wanted + len(spans), found + len(got)
    assert right / wanted > 0.97 and right / found > 0.97


def test_small_letters(model):
    text = "esperé media hora... y no llegó nadie. no lo compren!!! vendieron harina, té, café, etc. a mitad de precio. pagué $2.850 por 500 g."
    got = [text[a:b] for a, b in cut(text, *model)]
    assert len(got) >= 3 and got[0].endswith("nadie.")


@pytest.mark.parametrize(
    "text, units",
    [
        ("Lista N.º 3\n- 39 eggs\n5) harina\n• vino, $710\n9. ravioles", ["Lista N.º 3", "- 39 eggs", "5) harina", "• vino, $710", "9. ravioles"]),
        ("店员说：“今天没有优惠。明天再来。”我只好回家。“质量不错！”邻居这样评价。价格又涨了……真没办法。", ["店员说：“今天没有优惠。明天再来。”我只好回家。", "“质量不错！”邻居这样评价。", "价格又涨了……真没办法。"]),
        ("店員は「今日は割引です！また来てください。」と言った。（在庫は毎週補充されます。）No.87の棚は空だった。", ["店員は「今日は割引です！また来てください。」と言った。", "（在庫は毎週補充されます。）", "No.87の棚は空だった。"]),
        ("ขนมปังสดใหม่ทุกวัน ข้าวสารยี่ห้อนี้ราคา 13 บาทต่อถุง  คุณภาพดี", ["ขนมปังสดใหม่ทุกวัน", "ข้าวสารยี่ห้อนี้ราคา 13 บาทต่อถุง", "คุณภาพดี"]),
        ("दुकानदार बोला, “आज छूट नहीं है। कल आइए।” और चला गया। चावल का भाव रु. 98 है।", ["दुकानदार बोला, “आज छूट नहीं है। कल आइए।” और चला गया।", "चावल का भाव रु. 98 है।"]),
        ("قال د. سامر إن الزيت نفد. هل ما زال؟ راجعوا ص. 23 من التقرير.", ["قال د. سامر إن الزيت نفد.", "هل ما زال؟", "راجعوا ص. 23 من التقرير."]),
        ("El producto venía abierto, con olor raro y sin fecha de vencimiento. El gerente\ndijo que no. Fin.", ["El producto venía abierto, con olor raro y sin fecha de vencimiento.", "El gerente\ndijo que no.", "Fin."]),
        ("太贵了\n\n我买了米", ["太贵了", "我买了米"]), ("", []), ("  \n ", []), ("...", ["..."]), ("a", ["a"]),
    ],
)
def test_scripts_and_lines(model, text, units):
    assert [text[a:b] for a, b in cut(text, *model)] == units


def test_run_on_text(model):
    parts = ["太贵了", "我买了米面油等等", "你知道哪家超市更便宜吗", "送货花了8天", "太贵了", "我买了米面油等等", "你知道哪家超市更便宜吗", "送货花了8天"]
    text = "".join(parts)
    assert [text[a:b] for a, b in cut(text, *model)] == parts


def test_viterbi_is_the_best_path():
    rng = random.Random(4)
    m = ChainModel({f"f{i}": rng.uniform(-2, 2) for i in range(6)} | {f"t{a}{b}": rng.uniform(-1, 1) for a in "01" for b in "01"} | {"bias": 0.1})
    chain = [((f"f{rng.randrange(6)}", f"f{rng.randrange(6)}"), rng.choice([None, None, 0, 1])) for _ in range(9)]

    def score(tags):
        total, last = 0.0, 0
        for (features, settled), tag in zip(chain, tags, strict=True):
            if settled is not None and tag != settled:
                return -1e18
            total += m.weights[f"t{last}{tag}"] + (sum(m.weights[f] for f in features) + 0.1 if tag and settled is None else 0.0)
            last = tag
        return total

    best = max((score([(k >> i) & 1 for i in range(9)]), [(k >> i) & 1 for i in range(9)]) for k in range(512))
    assert score(m.decode(chain)) == pytest.approx(best[0])


def test_places_cover_the_end():
    for text in ("abc", "abc.", "abc. ", "a\n\nb", "“a", "a.b"):
        assert places(text)[-1].end == len(text.rstrip())


def test_operator_on_odd_rows(spark):
    long = "Pagué poco. " * 20_000
    rows = [(1, "Una. Dos.", "x", 1), (1, "Una. Dos.", None, None), (2, None, None, None), (3, "", None, None), (4, " \n", None, None), (None, "Sola", None, None), (5, long, None, None)]
    got = split_sentences(spark.createDataFrame(rows, "doc_id bigint, text string, k string, sent_no int")).collect()
    assert sorted((r.sent_no, r.start_pos, r.end_pos) for r in got if r.doc_id == 1) == [(1, 0, 4), (1, 0, 4), (2, 5, 9), (2, 5, 9)]
    assert {r.doc_id for r in got} == {1, None, 5} and sum(r.doc_id == 5 for r in got) == 20_000
    assert split_sentences(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
