import pytest
from pyspark.sql import functions as F

from pairloom.functions import text as X
from pairloom.functions.ngrams import alternating_sentence, heavy_atoms, kept_fragments, level_sentence, ngrams


@pytest.mark.parametrize("raw", ["\t a b \n", " x ", "\x1cq\x1f", "\u2003é\xa0", "plain", "", " \n "])
def test_strip_is_unicode_aware(one, raw):
    assert one(X.strip("c"), c=raw) == raw.strip()


@pytest.mark.parametrize("raw,task,body", [
    ("mol2cap: CCO\n", "mol2cap", "CCO"),
    ("\tcap2mol:cap2mol: a thing", "cap2mol", "a thing"),
    ("cap2mol: x mol2cap: y", "mol2cap", "cap2mol: x  y"),
    ("no marker", None, None),
])
def test_marker_routing(one, raw, task, body):
    assert one(X.task_of("c"), X.unmarked("c"), c=raw) == (task, body)


@pytest.mark.parametrize("raw,expected", [
    ("['a']", "a"), ('["it\'s"]', "it's"), (r"['C\\C=C']", "C\\C=C"), ("['a\\nb']", "a\nb"),
    ("C#N", "C#N"), ("['']", ""), ("['C/C=C\\\\nC']", "C/C=C\\nC"), ("plain ['x'] text", "plain ['x'] text"),
])
def test_printed_list(one, raw, expected):
    assert one(X.unlisted("c"), c=raw) == expected


def test_clean_up(one):
    raw = "['C#N\\n']"
    assert one(X.cleaned("c"), X.cleaned("c", strip_hash=True), c=raw) == ("C#N", "CN")
    assert one(X.cleaned_first_word("c"), c="[' assistant C#N rest\\n']") == "C#N"
    assert one(X.without_leading_mark("c"), c="[CLS] [CLS] a") == "[CLS] a"
    assert one(X.without_leading_mark("c"), c="a [CLS] b") == "a [CLS] b"


def test_tokens(one):
    assert one(X.words("c"), c="Ab-c éé 1.5") == ["ab", "-", "c", "éé", "1", ".", "5"]
    assert one(X.word_count("c"), c="Ab-c éé 1.5") == 7
    assert one(X.alnum_words("c"), c="--Ab c! é9") == ["ab", "c", "9"]
    assert one(X.characters("c"), c="éab") == ["é", "a", "b"]
    assert one(X.characters("c"), c="") == []
    assert one(X.without_special(F.split("c", " ")), c="[CLS] a [SEP] [PAD]") == ["a"]
    assert one(X.truncated(F.split("c", " "), 2), c="a b c") == ["a", "b"]


@pytest.mark.parametrize("phrase,text,expected", [
    ([], ["a"], True), (["a", "b"], ["a"], False), (["b", "c"], ["ab", "c"], False),
    (["b", "c"], ["a", "b", "c"], True), (["a"], ["a", "a"], True),
])
def test_contains_phrase(one, phrase, text, expected):
    assert one(X.contains_phrase("p", "t"), schema="p array<string>, t array<string>", p=phrase, t=text) is expected


def test_padding(one):
    assert one(X.padded("a", 5, 9), X.attention("a", 5), schema="a array<int>", a=[1, 2]) == ([1, 2, 9, 9, 9], [1, 1, 0, 0, 0])
    assert one(X.padded("a", 1, 9), X.attention("a", 1), schema="a array<int>", a=[1, 2]) == ([1], [1])


def test_ngrams_and_sentences(one):
    t = ["a", "b", "c"]
    assert one(ngrams("t", 2), t=t) == ["a b", "b c"]
    assert one(ngrams("t", 3), t=t) == ["a b c"]
    assert one(ngrams("t", 4), t=t) == []
    assert one(level_sentence("t", 1), t=t) == ["a_b", "b_c"]
    assert one(alternating_sentence("t", 1), t=t) == ["a", "a_b", "b", "b_c", "c"]
    assert one(alternating_sentence("t", 2), t=t) == ["a", "a_b", "a_b_c", "b", "b_c", "c"]


@pytest.mark.parametrize("smiles,count", [("CCO", 3), ("[Na+]", 1), ("[H][H]", 0), ("Clc1ccccc1Br", 8), ("[nH]1cccc1", 5), ("[2H]C", 1), ("[Hg]", 1), ("C[C@@H](N)C(=O)O", 6)])
def test_heavy_atoms(one, smiles, count):
    assert one(heavy_atoms(F.col("c")), c=smiles) == count


def test_fragments(one):
    assert one(kept_fragments("c"), kept_fragments("c", keep="small"), c="CCCCO.[Na+].CCO") == ("CCCCO", "[Na+].CCO")
