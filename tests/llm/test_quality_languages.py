"""Clean documents of null, rare and non-Latin languages stay among a Latin majority; junk goes."""

import random

from sievelight.llm import quality_rules

R = random.Random(5)
LATIN, ACCENTED, CYRILLIC, CJK = "abcdefghijklmnopqrstuvwxyz", "aaabcdeeehiilmnorstuvěščřžýáíé", "абвгдежзиклмнопрстуфхц", "天地人山水火木金土日月年"


def prose(letters, n=160, stop=". "):
    words = ["".join(R.choices(letters, k=R.randint(3, 8))) for _ in range(n)]
    out = []
    for i in range(0, n, 10):
        out.append(" ".join([words[i].capitalize(), *words[i + 1 : i + 10]]) + stop)
    return "".join(out)


def test_clean_documents_of_any_language_stay(spark):
    rows = [(i, prose(LATIN), "it") for i in range(60)]
    clean = [(t, lang) for letters, lang in ((LATIN, None), (ACCENTED, None), (CYRILLIC, None), (CJK, None), (LATIN, "pl"), (ACCENTED, "cs"), (CYRILLIC, "ru"), (CJK, "zh")) for t in [prose(letters, stop="。 " if letters == CJK else ". ")]]
    clean += [(prose(CYRILLIC), "bg") for _ in range(8)]
    rows += [(100 + i, t, lang) for i, (t, lang) in enumerate(clean)]
    junk = " ".join("".join(R.choices("#*$%&|<>0123456789abc", k=6)) for _ in range(200))
    rows += [(200, junk, None), (201, junk, "it")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == {200, 201}


def test_blocks_of_references_change_nothing(spark, monkeypatch):
    """With more references than a block holds, verdicts and distances are the same."""
    rows = []
    for k, lang in enumerate(["it", "pl", "cs", "ru", "bg", "zh", "fi"]):
        letters = [LATIN, LATIN, ACCENTED, CYRILLIC, CYRILLIC, CJK, LATIN[:12]][k]
        rows += [(100 * k + i, prose(letters), lang) for i in range(7)]
    rows += [(1000 + i, prose(R.choice([LATIN, ACCENTED, CJK, "#*$%&ab0123"])), R.choice([None, "xx", "yy"])) for i in range(25)]
    rows += [(2000, None, None), (2001, "", "it"), rows[-1]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = sorted(map(repr, quality_rules.quality_rules(df).collect()))
    for block in (1, 3):
        monkeypatch.setattr(quality_rules, "BLOCK", block)
        assert sorted(map(repr, quality_rules.quality_rules(df).collect())) == want
    assert sum("char_distance=None" not in r for r in want) > 60
