"""Word classes by closed-class lists and suffix rules.

The reference behaviour comes from a trained tagger that is not available here. These rules
use the same tag names, so the ratios mean the same thing, but single values differ.
"""

from __future__ import annotations

# Closed-class English words by Penn Treebank tag.
CLOSED_CLASS = {
    "PRP": "i you he she it we they me him us them myself yourself himself herself itself "
           "ourselves yourselves themselves".split(),
    "PRP$": "my your his her its our their".split(),
    "WP": "who whom what whoever".split(),
    "WP$": ["whose"],
    "DT": "the a an this that these those each every some any no".split(),
    "IN": "of in for on with at by from about into through during before after above below "
          "between under over against because although while if since until unless than as".split(),
    "CC": "and or but nor yet so".split(),
    "MD": "can could may might must shall should will would".split(),
    "TO": ["to"],
    "VB": "be have do go get make".split(),
    "VBP": "am are".split(),
    "VBZ": "is has does".split(),
    "VBD": "was were had did went got made said".split(),
    "VBN": "been done gone".split(),
    "RB": "not very too also never always often here there now then just only again".split(),
    "JJ": "good new old great high small large other many few".split(),
    "JJR": "better more less larger smaller higher".split(),
    "JJS": "best most least".split(),
}

NOUN_TAGS = ("NN", "NNS", "NNP", "NNPS")
VERB_TAGS = ("VB", "VBD", "VBG", "VBN", "VBP", "VBZ")
ADJECTIVE_TAGS = ("JJ", "JJR", "JJS")
ADVERB_TAGS = ("RB", "RBR", "RBS")
PRONOUN_TAGS = ("PRP", "PRP$", "WP", "WP$")

# Tried in order on words that are in no list.
SUFFIX_TAGS = [
    ("ly", "RB"), ("ing", "VBG"), ("ed", "VBD"), ("ous", "JJ"), ("ful", "JJ"), ("ive", "JJ"), ("s", "NNS"),
]
WORD_START = r"^[\p{L}\p{M}_]"
NUMBER_START = r"^\p{N}"

CLOSED_CLASS_WORDS = sorted({word for words in CLOSED_CLASS.values() for word in words})
DEFAULT_STOP_WORDS = CLOSED_CLASS_WORDS


def _listed(words: list[str] | tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{word}'" for word in words) + ")"


def pos_tag(token: str) -> str:
    """SQL text that tags the lower-case token named ``token``; punctuation is tagged as itself."""
    closed = " ".join(f"WHEN {token} IN {_listed(words)} THEN '{tag}'" for tag, words in CLOSED_CLASS.items())
    suffixes = " ".join(f"WHEN endswith({token}, '{end}') THEN '{tag}'" for end, tag in SUFFIX_TAGS)
    # One hashed look-up settles most tokens before the per-tag lists are tried.
    return (
        f"CASE WHEN {token} IN {_listed(CLOSED_CLASS_WORDS)} THEN CASE {closed} END "
        f"WHEN rlike({token}, r'{WORD_START}') THEN CASE {suffixes} ELSE 'NN' END "
        f"WHEN rlike({token}, r'{NUMBER_START}') THEN 'CD' ELSE {token} END"
    )
