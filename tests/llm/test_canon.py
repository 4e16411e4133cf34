import pytest

canon = pytest.importorskip("loomspark.llm.canon")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def entries(spark):
    return spark.read.parquet(f"{DATA}/canon_values.parquet")


CASES = [
    ("func", "쓰기 ", "쓰기"), ("func", "쓰긔 중심", "쓰기"), ("func", "작문(쓰기)", "쓰기"), ("func", "말 하기", "말하기"), ("func", "어희", "어휘"), ("func", "특정 기능 아님(비특정)", "기능비특정"),
    ("func", "literature & culture", "문학·문화"), ("func", "채점·평가", "평가·채점"), ("func", "회계", ""), ("func", "음악 감상", ""), ("func", "n/a", ""), ("func", "999", ""), ("func", "ㅁㄴㅇㄹ", ""),
    ("meth", "수업모형 개발", "개발연구"), ("meth", "experimnt", "실험연구"), ("meth", "질젹·사례", "질적·사례"), ("meth", "corpus anaylsis", "코퍼스분석"), ("meth", "혼합", "기타·혼합"),
    ("tool", "ChatGTP", "ChatGPT"), ("tool", "ＣｈａｔＧＰＴ", "ChatGPT"), ("tool", "「생성 AI 일반」", "생성형AI일반"), ("tool", "중국어엘엘엠(LLM)", "중국어LLM"), ("tool", "신경망 기계번역", "기계번역"), ("tool", "chat bot?", "챗봇"), ("tool", "저자 문의", ""),
]


def test_values(spark, entries):
    df = spark.createDataFrame([(k, *(v if a == x else None for x in ("func", "meth", "tool"))) for k, (a, v, _) in enumerate(CASES)], "verdict_id bigint, func string, meth string, tool string")
    got = {r["verdict_id"]: (r["axis"], r["canon_value"]) for r in canon.map_values(df, "verdict_id", ("func", "meth", "tool"), entries).collect()}
    assert got == {k: (a, want) for k, (a, _, want) in enumerate(CASES)}


def test_odd_tables(spark, entries):
    df = spark.createDataFrame([(1, None, "쓰기"), (1, " 　", "쓰기"), (2, "x" * 100_000, ""), (None, "쓰기", "쓰기"), (None, "쓰기", "쓰기")], "k bigint, axis string, func string")
    rows = canon.map_values(df, "k", ("axis", "func"), entries)
    assert rows.where("axis = 'axis'").select("canon_value").distinct().collect() == [("",)]
    assert rows.where("axis = 'func'").count() == 4
    assert canon.typed_otherwise(rows.where("axis = 'func'"), entries).count() == 0
    assert canon.map_values(df.limit(0), "k", ("func",), entries).count() == 0
    assert canon.map_values(df, "k", ("func",), entries.limit(0)).where("canon_value <> ''").count() == 0


def test_longest_mention_wins_and_similarity_is_symmetric():
    m = canon.CanonMatcher([("번역", []), ("기계번역", ["번역기"])])
    assert m.match("신경망기계번역시스템") == 1 and m.match("번역 수업") == 0
    assert canon.edit_similarity("abcd", "abdc") == canon.edit_similarity("abdc", "abcd") == 0.75
    assert canon.edit_similarity("", "a") == 0 and canon.edit_similarity("가", "가") == 1


#: Values made up by hand for this test, with the entry a reader would choose; none of them was used to choose a rule.
CANON = {
    "func": [("쓰기", ["작문", "writing"]), ("말하기", ["회화", "speaking"]), ("읽기", ["독해", "reading"]), ("번역", ["통번역", "translation"]), ("문법", ["grammar"]), ("발음", ["pronunciation"]), ("어휘", ["단어", "vocabulary"]), ("듣기", ["청해", "listening"])],
    "tool": [("ChatGPT", ["챗지피티", "GPT"]), ("생성형AI일반", ["생성형 인공지능", "generative AI"]), ("기계번역", ["번역기", "machine translation"]), ("챗봇", ["대화봇", "chatbot"]), ("BERT·NLP", ["BERT", "NLP"]), ("음성인식·TTS", ["음성인식", "speech recognition"])],
    "meth": [("개발연구", ["설계·개발", "design and development"]), ("조사연구", ["설문조사", "survey"]), ("실험연구", ["준실험", "experiment"]), ("질적·사례", ["사례연구", "case study"]), ("문헌·리뷰", ["문헌연구", "literature review"]), ("코퍼스분석", ["말뭉치 분석", "corpus analysis"])],
}
HAND = {
    "func": "독해력=읽기 작문지도=쓰기 speaking_practice=말하기 listenning=듣기 어휘력_신장=어휘 gramar=문법 readng=읽기 번역하기=번역 translatoin=번역 prononciation=발음 쓰기_지도=쓰기 듣기평가=듣기 vocabulary_size=어휘 통번역_실습=번역 외국인_회화=말하기 WRITTING=쓰기 말하기/토론=말하기 speaking(oral)=말하기 요리= 수학= 없음= tbd= ?? 42=",
    "tool": "chat-gpt_4=ChatGPT 챗_지피티=ChatGPT GPT-4o=ChatGPT 구글_번역기=기계번역 machine-translation=기계번역 챗_봇=챗봇 chat_bot=챗봇 speech_recognitoin=음성인식·TTS 생성_인공지능=생성형AI일반 bert_base=BERT·NLP Generative-AI=생성형AI일반 chatbots=챗봇 NLP_toolkit=BERT·NLP 음성_인식기=음성인식·TTS 자동차= egypt= ming_ptolemy= sunlpark= 칠판= 기린=",
    "meth": "설문_조사=조사연구 준_실험=실험연구 사례_연구=질적·사례 surveys=조사연구 corpus-analysis=코퍼스분석 말뭉치분석=코퍼스분석 개발·설계=개발연구 case_studies=질적·사례 experimental=실험연구 literatur_review=문헌·리뷰 문헌_고찰=문헌·리뷰 질적_접근=질적·사례 desing_and_development=개발연구 실험_설계=실험연구 고양이= 커피= none= 11=",
}


def test_hand_made_values():
    asked = right = answered = meant = 0
    for axis, text in HAND.items():
        m = canon.CanonMatcher(CANON[axis])
        for pair in text.split():
            typed, _, want = pair.replace("_", " ").partition("=")
            k = m.match(typed)
            got = m.values[k] if k >= 0 else ""
            asked, answered, meant, right = asked + 1, answered + (got != ""), meant + (want != ""), right + (got == want != "")
            if got != want:
                print(axis, typed, repr(got), repr(want))
    print(asked, right, answered, meant)
    assert asked >= 60 and right / answered >= 0.9 and right / meant >= 0.9


def test_mentions_keep_word_borders():
    m = canon.CanonMatcher(CANON["tool"])
    name = lambda t: m.values[k] if (k := m.match(t)) >= 0 else ""
    assert m.embedded("big ptolemy") == m.embedded("fun lp record") == -1 and name("big ptolemy") == "" and name("챗GPT") == name("chat gpt") == name("my gpt 4") == "ChatGPT" and name("두 챗 봇") == "챗봇"


def test_only_candidates_are_scored_and_none_is_lost():
    import random

    rng = random.Random(8)
    names = sorted({"".join(rng.choice("abcdefgh가나다라마") for _ in range(rng.randrange(3, 9))) for _ in range(400)})
    m = canon.CanonMatcher([(n, []) for n in names])
    full = canon.CanonMatcher([(n, []) for n in names])
    everything = list(range(len(full.names)))
    full.index = {g: everything for g in {*full.index}}
    for n in rng.sample(names, 60):
        i = rng.randrange(len(n))
        typed = n[:i] + rng.choice("abc가나") + n[i + rng.randrange(2) :]
        assert m.similar(typed, typed) == full.similar(typed, typed)
