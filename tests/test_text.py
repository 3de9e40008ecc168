import unicodedata
import uuid

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from duoglot.functions import text

SAMPLES = ["plain", "", " lead and trail\t\n", " ā x ", "　saṃsāra　", "½ ﬁ …", "한글 법",
           "Été ñandú ß", "法", "Привет", "á̧", "̈́", "Tepajja pupphitā sabbe, dhuvaṃ", None]


def one(spark, values, *columns):
    return spark.createDataFrame([(v,) for v in values], "s string").select("s", *columns).collect()


def plain_fold(s):
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def test_normalize_and_fold_match_unicode_rules(spark):
    for row in one(spark, SAMPLES, text.normalize_nfc("s").alias("n"),
                   text.strip_diacritics("s").alias("f")):
        if row["s"] is None:
            assert row["n"] is None and row["f"] is None
        else:
            assert row["n"] == unicodedata.normalize("NFC", row["s"]).strip()
            assert row["f"] == plain_fold(row["s"])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=("Cs",), exclude_characters="\x00")),
                min_size=40, max_size=80))
def test_any_text_normalizes_like_unicode(spark, values):
    for row in one(spark, values, text.normalize_nfc("s").alias("n"),
                   text.strip_diacritics("s").alias("f"), text.uuid5_dns("s").alias("u")):
        assert row["n"] == unicodedata.normalize("NFC", row["s"]).strip()
        assert row["f"] == plain_fold(row["s"])
        assert row["u"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, row["s"]))


def test_whitespace_is_what_unicode_says():
    assert set(text.WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


@pytest.mark.parametrize("query,lang", [
    ("法", "zh"), ("Привет", "ru"), ("saṃsāra", "pali"), ("señor", "pali"), ("saṃ", "en"),
    ("anicca", "en"), ("hello ñ 法", "zh"), ("ÑANDÚ", "pali"), ("", "en")])
def test_language_guess(spark, query, lang):
    assert one(spark, [query], text.detect_lang("s").alias("l"))[0]["l"] == lang


def test_keyword_query_is_folded_for_pali_only(spark):
    column = text.keyword_query("s", text.detect_lang("s")).alias("k")
    rows = {r["s"]: r["k"] for r in one(spark, ["saṃsāra", "Été", "anicca"], column)}
    assert rows == {"saṃsāra": "samsara", "Été": "Été", "anicca": "anicca"}


def test_uuid_of_known_key(spark):
    row = one(spark, ["doc_1"], text.uuid5_dns("s").alias("u"))[0]
    assert row["u"] == "10e57509-1331-560e-b825-b49df3fe209b"


def test_keys_and_concatenation(spark):
    df = spark.createDataFrame([("b", "1", "p", "t"), ("b", None, "p", None), (None, "2", "", "t"),
                                ("b", "3", None, None)], "book_id string, para_id string, p string, t string")
    rows = df.select(text.doc_key(["book_id", "para_id"]).alias("k"), text.concat_all(["p", "t"]).alias("all"),
                     text.concat_nonempty(["p", "t"]).alias("some"), text.snippet("p", "t").alias("snip"),
                     text.citation_tag().alias("tag")).collect()
    assert [r["k"] for r in rows] == ["b:1", "b:nan", "nan:2", "b:3"]
    assert [r["all"] for r in rows] == ["p \n t", "p \n ", " \n t", " \n "]
    assert [r["some"] for r in rows] == ["p \n t", "p", "t", ""]
    assert [r["snip"] for r in rows] == ["p \n t", "p", "t", ""]
    assert [r["tag"] for r in rows] == ["[b:1]", "[b:?]", "[?:2]", "[b:3]"]


def test_null_id_can_fail_the_job(spark):
    df = spark.createDataFrame([("b", None)], "book_id string, para_id string")
    with pytest.raises(Exception, match="missing id in column para_id"):
        df.select(text.doc_key(["book_id", "para_id"], "error")).collect()


def test_tokens(spark):
    rows = one(spark, ["The  cat's—Ñandú, 3x!", "…", None, "āb"], text.tokens("s").alias("t"),
               text.has_token("s").alias("h"))
    assert [r["t"] for r in rows] == [["the", "cat", "s", "ñandú", "3x"], [], [], ["āb"]]
    assert [r["h"] for r in rows] == [True, False, False, True]


def test_quick_check_lets_only_stable_texts_pass(spark):
    import random
    import re
    import unicodedata
    pattern = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", text.NFC_UNSURE))
    second = {0x1161 + i for i in range(21)} | {0x11A8 + i for i in range(27)}     # Hangul vowels and finals
    for code in [*range(0xD800), *range(0xE000, 0x20000)]:
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            second.add(int(parts[1], 16))
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)]):
        if not pattern.search(c):
            assert ord(c) not in second and not unicodedata.combining(c) and unicodedata.normalize("NFC", c) == c
    assert not pattern.search("plain, déjà vu, Straße, ñandú, āīūḍḷṇṭ, Привет, 中文 – “한”, かな")
    assert pattern.search("e\u0301") and pattern.search("\u1100\u1161") and pattern.search("\u212b")
    draw = random.Random(1)
    letters = [*"ae \n", "\u0301", "\u0323", "é", "\u1e69", "\u1100", "\u1161", "\u11a8", "가", "\u212b", "\u0958", "\u2adc", "中", "😀", "\U0001d15e"]
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 12))) for _ in range(400)]
    for t in texts:
        assert pattern.search(t) or unicodedata.normalize("NFC", t) == t
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = dict(map(tuple, df.select("i", text.normalize_nfc("t")).collect()))
    assert got == {i: unicodedata.normalize("NFC", t).strip() for i, t in enumerate(texts)}


def test_the_first_nfc_test_finds_all_that_the_second_one_does():
    import re
    def compiled(pattern):
        return re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", pattern))
    first, second = compiled(text.NFC_BEYOND), compiled(text.NFC_UNSURE)
    unsure = [c for c in map(chr, range(0x110000)) if second.match(c)]
    assert unsure and all(first.match(c) for c in unsure)
    assert not first.search("Se que ñezll, ciónñgaco übergröße façade")
