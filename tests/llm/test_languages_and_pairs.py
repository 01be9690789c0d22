import random

import pandas as pd
import pytest

from reelspan.llm.hyper import document_languages, fit_profiles, label_documents, sentence_text
from reelspan.llm.labels import label_language, labelled_sample
from reelspan.llm.pairs import DECLINES, LanguageBayes, PairModel, _letters, pair_defects, tally
from reelspan.runtime import read

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def sample(spark):
    return labelled_sample(read(spark, SF, "documents"))


@pytest.fixture(scope="module")
def profiles(sample):
    return fit_profiles(sample)


def test_labels():
    right = {"EN": "en", "en_GB": "en", "zh_Hans": "zh", "zho": "zh", "Deutsch": "de", "русский": "ru", "日本語": "ja", " Français ": "fr", "uk-UA": "uk", "español": "es", "Español (México)": "es"}
    assert {k: label_language(k) for k in right} == right
    assert [label_language(x) for x in (None, "", " ", "und", "unknown", "it", "123")] == [None] * 7


def test_held_out_lines(sample):
    half = len(sample) // 2
    model = fit_profiles(sample[:half])
    right = total = 0
    for lang, text in sample[half:]:
        found = document_languages(model, [text])[0]
        total += bool(found)
        right += bool(found) and found[0][1] == lang
    assert right / total > 0.9  # labels are wrong in part


def test_what_shows_no_language():
    assert [sentence_text(x) for x in ("https://a.example/x", "#some #tags", "01:23", "Lona Repita", "莱博罗恩·蒂波梅勒", "", "{\\i1}<b>")] == [""] * 7
    assert sentence_text("Dialogue: 0,0:00:00.00,0:00:00.90,ZH,,0,0,0,,你好，朋友。(see you)") == "你好 朋友"
    assert sentence_text("“Only a quote here.”") == "only a quote here"
    assert len(sentence_text("“" * 200_000 + "a b c d.")) < 20


def test_documents(spark, profiles):
    en, zh = "The old critic burned the second draft behind the cinema.", "老评论家在电影院后面烧掉了第二版草稿。"
    ru = "staryy kritik szhyog vtoroy chernovik za kinoteatrom."
    rows = [(1, f"{en}\n{en}", "English"), (2, f"{en}\n\n{zh}\r\n{en}", "en"), (3, en, None), (4, zh, "ja"), (5, None, "en"), (6, " ", "en"), (7, "https://x.example", None), (8, f"{en} («{zh}»)\n#tag", "en"), (None, en, "und"), (9, ru, "ru"), (10, (en + "\n") * 3000, "eng")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, line_no int")
    got = sorted(((r.doc_id or 0, r.line_no, r.lang) for r in label_documents(df, profiles).collect()))
    assert got == [(0, 0, "en"), (2, 1, "en"), (2, 3, "zh"), (2, 4, "en"), (3, 0, "en"), (4, 0, "zh")]
    assert all(0 < r.confidence <= 1 for r in label_documents(df, profiles).collect())
    assert label_documents(df.limit(0), profiles).count() == 0


PAIRS = [
    ("The old critic burned the second draft.", "老评论家烧掉了第二版草稿。", None),
    ("Nobody answered.", "没人回答。", None), ("Yes, exactly.", "对，没错。", None), ("Marble Mirror 7", "Marble Mirror 7", None),
    ("I'm sorry, I can't help you.", "抱歉，我帮不了你。", None), ("but the shop owner near the harbour", "但店主在港口附近", None), (None, "老评论家烧掉了第二版草稿。", None),
    ("The shop owner sold the tape. C:/archive/some_very_long_name_of_a_file_that_is_kept", "店主卖掉了母带。C:/archive/some_very_long_name_of_a_file_that_is_kept", None),
    ("A", None, "empty"), (None, None, "empty"), ("A b.", " \u200b\n", "empty"), ("A b.", "[空]", "empty"), ("A b.", "N/A", "empty"), ("A b.", "{\\i1}{\\i0}", "empty"), ("A b.", "译文：", "empty"), ("A b.", "……", "empty"),
    ("The tour manager found a tape.", "THE TOUR MANAGER FOUND A TAPE", "copy"), ("The tour manager found a strange tape.", "译文：The tour maanger found strange tape.", "copy"), ("Silent Garden", "Silent Garden", "copy"),
    ("The radio host hid the camera.", "Sorry, I cannot translate this passage.", "refusal"), ("The radio host hid the camera.", "作为一个语言模型，我不能处理这个请求。", "refusal"), ("Тихий продюсер купил ленту.", "Извините, этот запрос нельзя выполнить.", "refusal"),
    ("The radio host hid the camera.", "很遗憾，该内容不适合翻译。（“The radio host”）", "refusal"),
    ("After the concert, the night guard sold a rare photograph.", "Nach dem Konzert verkaufte der Nachtwächter ein seltenes Foto.", "wrong_language"), ("The night guard sold a rare photograph.", "夜の警備員は珍しい写真を売った。", "wrong_language"),
    ("The night guard sold a rare photograph.", "译文：Ночной сторож продал редкую фотографию.", "wrong_language"),
    ("The old critic burned the second draft, because the shop owner sold the master tape at the flea market.", "老评论家烧掉了第二版草稿。", "truncated"),
    ("After the concert, the night guard sold a rare photograph in the old studio.", "演唱会结束后，夜班保安在", "truncated"), ("After the concert, the night guard sold a rare photograph in the old studio.", "演唱会结束后，夜班……", "truncated"),
]


def test_pair_defects(spark, sample):
    segments = read(spark, SF, "segments").selectExpr("'bulk' AS v", "id + 1000 AS id", "source_text AS s", "target_text AS t", "1L AS version", "0 AS defect")
    rows = spark.createDataFrame([("v", k, s, t, 2, 0) for k, (s, t, _) in enumerate(PAIRS)] + [("v", 0, "A", None, 1, 0), (None, None, "x" * 200_000, "y" * 200_000, 1, 0)], "v string, id long, s string, t string, version long, defect int")
    model = LanguageBayes.fit(sample)
    found = pair_defects(segments.unionByName(rows), model, ["Marble Mirror"], key=["v", "id"], source="s", target="t", version="version")
    got = {r.id: r.defect for r in found.where("v = 'v'").collect()}
    for k, (s, t, want) in enumerate(PAIRS):
        assert got.get(k) == want, (s, t, want, got.get(k))
    assert pair_defects(rows.limit(0), model, [], key=["v", "id"], source="s", target="t", version="version").count() == 0


#: Ways to decline that stand in no list of the package, and things that speakers say.
HELD_OUT = [
    "I'm afraid translating this passage is something I cannot do.", "My guidelines prohibit me from processing your text.", "This segment could not be translated because it violates a policy.", "As an AI, I must decline this translation request.",
    "本模型无法提供此段内容的翻译。", "抱歉，您的请求违反政策，不能翻译。", "此文本不适合处理，请更换内容。", "К сожалению, данный текст не может быть переведён по правилам.", "Как ИИ-модель, я отказываюсь обрабатывать этот запрос.",
    "Leider ist mir die Übersetzung dieses Textes nicht erlaubt.", "Désolé, la traduction de ce contenu n'est pas possible.", "Lo siento, no es posible traducir este contenido.", "申し訳ありませんが、このテキストは翻訳できません。",
]
OWN = ["对不起，我今晚不能来。", "抱歉，我忘了。", "我无法忘记那场演出。", "很遗憾，他们没有赢。", "我不会再去那里。", "没有人能帮助他。", "请坐下来等我。"]


def test_refusals_by_likelihood(spark, sample):
    model = LanguageBayes.fit(sample)
    at = lambda texts: model.judged([_letters(t) for t in texts])[1]
    assert (at(HELD_OUT) >= DECLINES).mean() >= 0.8
    assert (at(OWN) < DECLINES).all()
    plain = [t for _, text in sample for t in text.split("\n") if len(t) > 20][:2000]
    assert (at(plain) >= DECLINES).mean() < 0.01


@pytest.mark.parametrize("lang, text", [
    ("de", "Der alte Kritiker verbrannte gestern den zweiten Entwurf hinter dem Kino."), ("fr", "Le vieux critique brûla le deuxième brouillon derrière le cinéma."), ("es", "El viejo crítico quemó el segundo borrador detrás del cine."),
])
def test_languages_of_one_script(sample, lang, text):
    model = PairModel(LanguageBayes.fit(sample), [])
    source = "The old critic burned the second draft behind the cinema."
    assert model.defects([source], [text], [False]) == ["wrong_language"]
    assert model.defects([source], [source.replace("burned", "burnd")], [False]) == ["copy"]
    assert model.languages.languages[model.languages.posteriors([text.lower()])[0].argmax()] == lang
    assert model.defects(["Старый критик сжёг второй черновик за кинотеатром."], ["Старий критик спалив другу чернетку за кінотеатром."], [False]) == ["wrong_language"]


def test_end_likelihood_decides_truncation(spark, sample):
    """Held-out cuts of whole targets are found, whole ones aren't flagged; without the likelihood next to none is found."""
    rows = read(spark, SF, "segments").select("source_text", "target_text").dropna().distinct().toPandas()
    whole = rows[rows.target_text.str.match(r"^[\u4e00-\u9fff]{9,}[^\n{<]*。$") & rows.source_text.str.contains(r"[.]\s*$")].reset_index(drop=True)
    held, rest = whole.iloc[::9], rows
    frame = pd.concat(tally(iter([rest.rename(columns={"source_text": "source", "target_text": "target"})])))
    model = PairModel(LanguageBayes.fit(sample), list(frame.itertuples(index=False)))
    rng = random.Random(4)
    cut = [(s, t[: rng.randint(3, max(3, len(t) * 6 // 10))].rstrip("，。、") + rng.choice(["", "，", "——", "……", "-"])) for s, t in zip(held.source_text, held.target_text, strict=True)]
    found = lambda pairs: sum(model.truncated(s, t) for s, t in pairs) / len(pairs)
    assert len(cut) > 50
    assert found(cut) > 0.98
    assert found(list(zip(held.source_text, held.target_text, strict=True))) < 0.02
    model.end_likelihood = lambda s, t: 0.0
    assert found(cut) < 0.5
    model.end_likelihood = PairModel.end_likelihood.__get__(model)
    model.stop_odds = lambda s, t: 1.0
    assert found(cut) == 0


def test_language_bayes_is_sure(sample):
    rng = random.Random(9)
    half = len(sample) // 2
    model = LanguageBayes.fit(sample[:half])
    pick = [x for x in rng.sample(sample[half:], 60) if len(sentence_text(x[1].split("\n")[0])) > 10]
    p = model.posteriors([sentence_text(t.split("\n")[0]) for _, t in pick])
    assert sum(model.languages[k] == lang for k, (lang, _) in zip(p.argmax(axis=1), pick, strict=True)) > 0.85 * len(pick)
