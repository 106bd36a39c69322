"""Fixed lookup values: contractions and phoneme attributes, as plain tables and as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Contracted form and the words it stands for.
CONTRACTIONS = {
    "ain't": "is not",
    "aren't": "are not",
    "can't": "cannot",
    "can't've": "cannot have",
    "'cause": "because",
    "could've": "could have",
    "couldn't": "could not",
    "couldn't've": "could not have",
    "didn't": "did not",
    "doesn't": "does not",
    "don't": "do not",
    "hadn't": "had not",
    "hadn't've": "had not have",
    "hasn't": "has not",
    "haven't": "have not",
    "he'd": "he would",
    "he'd've": "he would have",
    "he'll": "he will",
    "he'll've": "he he will have",
    "he's": "he is",
    "how'd": "how did",
    "how'd'y": "how do you",
    "how'll": "how will",
    "how's": "how is",
    "i'd": "i would",
    "i'd've": "i would have",
    "i'll": "i will",
    "i'll've": "i will have",
    "i'm": "i am",
    "i've": "i have",
    "isn't": "is not",
    "it'd": "it would",
    "it'd've": "it would have",
    "it'll": "it will",
    "it'll've": "it will have",
    "it's": "it is",
    "let's": "let us",
    "ma'am": "madam",
    "mayn't": "may not",
    "might've": "might have",
    "mightn't": "might not",
    "mightn't've": "might not have",
    "must've": "must have",
    "mustn't": "must not",
    "mustn't've": "must not have",
    "needn't": "need not",
    "needn't've": "need not have",
    "o'clock": "of the clock",
    "oughtn't": "ought not",
    "oughtn't've": "ought not have",
    "shan't": "shall not",
    "sha'n't": "shall not",
    "shan't've": "shall not have",
    "she'd": "she would",
    "she'd've": "she would have",
    "she'll": "she will",
    "she'll've": "she will have",
    "she's": "she is",
    "should've": "should have",
    "shouldn't": "should not",
    "shouldn't've": "should not have",
    "so've": "so have",
    "so's": "so as",
    "that'd": "that would",
    "that'd've": "that would have",
    "that's": "that is",
    "there'd": "there would",
    "there'd've": "there would have",
    "there's": "there is",
    "they'd": "they would",
    "they'd've": "they would have",
    "they'll": "they will",
    "they'll've": "they will have",
    "they're": "they are",
    "they've": "they have",
    "to've": "to have",
    "wasn't": "was not",
    "we'd": "we would",
    "we'd've": "we would have",
    "we'll": "we will",
    "we'll've": "we will have",
    "we're": "we are",
    "we've": "we have",
    "weren't": "were not",
    "what'll": "what will",
    "what'll've": "what will have",
    "what're": "what are",
    "what's": "what is",
    "what've": "what have",
    "when's": "when is",
    "when've": "when have",
    "where'd": "where did",
    "where's": "where is",
    "where've": "where have",
    "who'll": "who will",
    "who'll've": "who will have",
    "who's": "who is",
    "who've": "who have",
    "why's": "why is",
    "why've": "why have",
    "will've": "will have",
    "won't": "will not",
    "won't've": "will not have",
    "would've": "would have",
    "wouldn't": "would not",
    "wouldn't've": "would not have",
    "y'all": "you all",
    "y'all'd": "you all would",
    "y'all'd've": "you all would have",
    "y'all're": "you all are",
    "y'all've": "you all have",
    "you'd": "you would",
    "you'd've": "you would have",
    "you'll": "you will",
    "you'll've": "you will have",
    "you're": "you are",
    "you've": "you have",
    "girl's": "girl",
    "husband's": "husband",
}

#: The attributes that are listed, in order.
ATTRIBUTES = ["voiced", "unvoiced", "sonorant", "syllabic", "consonantal", "approximant", "plosive", "fricative", "nasal", "strident", "labial", "coronal", "dorsal", "anterior", "front", "back", "high", "low", "obstruent"]

#: The phonemes of each attribute. ``semivowel`` can be asked for but is not among the listed attributes.
ARPABET = {
    "voiced": "AA AO OW AH UH UW IY IH EY EH AE AW AY OY W Y L R M N NG Z V DH B D G CH JH ER",
    "unvoiced": "TH F S SH P T K",
    "sonorant": "AA AO OW AH UH UW IY IH EY EH AE AW AY OY W Y L R M N NG",
    "syllabic": "AA AO OW AH UH UW IY IH EY EH AE AW AY OY",
    "consonantal": "L R DH TH F S SH Z V P T K B D G M N NG",
    "approximant": "W Y L R",
    "plosive": "P T K B D G",
    "strident": "Z S SH",
    "labial": "P B M F V",
    "coronal": "D T R L N S Z SH",
    "anterior": "T D S Z TH DH P B F V M N L R",
    "dorsal": "K G NG",
    "front": "IY IH EH AE",
    "back": "UW UH AO AA",
    "high": "IY IH UH UW",
    "low": "EH AE AA AO",
    "nasal": "M N NG",
    "fricative": "F V S Z SH TH DH",
    "semivowel": "W L R Y",
    "obstruent": "DH TH F S SH Z V P T K B D G",
}

#: The other alphabet writes these three otherwise, and all in lower case.
IPA_SPELLING = {"AH": "axh", "UH": "uxh", "IH": "ixh"}


def phonemes(attribute: str, mode: str = "Arpabet") -> list[str]:
    """Phonemes of an attribute, named in any case; unknown attributes have none."""
    if mode not in ("Arpabet", "IPA"):
        raise ValueError(f"unknown alphabet: {mode}")
    found = ARPABET.get(attribute.lower(), "").split()
    return found if mode == "Arpabet" else [IPA_SPELLING.get(p, p.lower()) for p in found]


def attribute_table(spark: SparkSession) -> DataFrame:
    """(mode, pos, attribute, phoneme): pos is the attribute's place in the list, null where it is not listed."""
    rows = [(mode, ATTRIBUTES.index(a) if a in ATTRIBUTES else None, a, p) for mode in ("Arpabet", "IPA") for a in ARPABET for p in phonemes(a, mode)]
    return spark.createDataFrame(rows, "mode string, pos int, attribute string, phoneme string")
