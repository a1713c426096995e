"""Word lists and lookup tables. All are plain parameters: pass your own table to replace any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.scale import local_table

# Supported languages and the model package reported for each.
LANGUAGE_MODELS = {
    "en": "en_core_web_sm",
    "de": "de_core_news_sm",
    "es": "es_core_news_sm",
    "fr": "fr_core_news_sm",
}

# Three-letter codes folded to two letters.
THREE_LETTER_CODES = {"eng": "en", "deu": "de", "ger": "de", "spa": "es", "fra": "fr", "fre": "fr"}

# Embedding back ends, default model and dimension.
EMBEDDING_MODELS = {
    "miniLM": ("sentence-transformers/all-MiniLM-L6-v2", 384),
    "bge-m3": ("BAAI/bge-m3", 1024),
    "openai-te3": ("text-embedding-3-small", 1536),
}

# Parser labels and the Universal Dependencies relation each becomes.
UD_RELATIONS = {
    "ROOT": "root", "prep": "case", "pobj": "obl", "dobj": "obj", "iobj": "iobj", "nsubj": "nsubj",
    "nsubjpass": "nsubj:pass", "csubj": "csubj", "csubjpass": "csubj:pass", "aux": "aux",
    "auxpass": "aux:pass", "cop": "cop", "conj": "conj", "cc": "cc", "punct": "punct", "mark": "mark",
    "advmod": "advmod", "amod": "amod", "det": "det", "poss": "nmod:poss", "compound": "compound",
    "appos": "appos", "nummod": "nummod", "acl": "acl", "xcomp": "xcomp", "ccomp": "ccomp",
    "advcl": "advcl", "relcl": "acl:relcl", "intj": "discourse",
}

# Function words with their part of speech, per language. They double as stop words and as evidence for
# language identification.
FUNCTION_WORDS = {
    "en": {
        "DET": "the a an this that these those each every some any all both another",
        "ADP": "of in for on with by at from into over under between about after before during through against",
        "AUX": "is was be are were been being am has have had having do does did will would can could may might "
               "must shall should",
        "PRON": "it he she they we you i me him her us them its his their our your my who whom which what itself",
        "CCONJ": "and or but nor",
        "SCONJ": "as if because while although since than when where",
        "PART": "to not",
        "ADV": "no very too also then there here so just only more most such own same once again further",
    },
    "fr": {
        "DET": "le la les un une des du ce cette ces mon ton son ma ta sa mes tes ses notre votre leur leurs",
        "ADP": "de en pour par dans sur avec à chez sans sous entre vers au aux",
        "AUX": "est sont été être ai as avons avez ont avait était sera serait",
        "PRON": "qui je tu il elle nous vous ils elles on se me te lui eux y moi toi",
        "CCONJ": "et ou mais ni car donc",
        "SCONJ": "que quand comme si lorsque puisque",
        "ADV": "pas ne plus très aussi bien",
    },
    "de": {
        "DET": "der die das den dem des ein eine einen einem einer eines dieser diese dieses jeder jede alle",
        "ADP": "in von zu mit auf für im am an aus bei nach seit über unter vor zum zur durch gegen ohne um",
        "AUX": "ist sind war waren sein bin bist hat haben hatte hatten wird werden wurde kann können muss soll will",
        "PRON": "sich ich du er sie es wir ihr mich dich ihm ihn uns euch man was wer",
        "CCONJ": "und oder aber denn sondern",
        "SCONJ": "als dass wenn weil ob damit während",
        "PART": "nicht",
        "ADV": "auch nur noch schon sehr so hier dort dann nun",
    },
    "es": {
        "DET": "el la los las un una unos unas este esta estos estas ese esa mi tu su sus mis tus nuestro cada todo todos",
        "ADP": "de en con por para del al a sin sobre entre hasta desde hacia según durante contra ante",
        "AUX": "es son era eran fue ser ha han había he hemos está están sido será",
        "PRON": "se lo le les yo él ella nosotros ellos ellas usted me te nos quien esto eso",
        "CCONJ": "y e o u pero ni sino",
        "SCONJ": "que cuando como si porque donde aunque",
        "ADV": "no más muy también ya sí así",
    },
}

# Irregular forms and their dictionary form, per language.
IRREGULAR_LEMMAS = {
    "en": "is:be was:be are:be were:be been:be being:be am:be has:have had:have having:have does:do did:do an:a "
          "children:child men:man women:woman people:person feet:foot teeth:tooth mice:mouse went:go gone:go "
          "said:say made:make took:take better:good best:good worse:bad worst:bad ones:one things:thing",
    "fr": "est:être sont:être été:être ai:avoir as:avoir ont:avoir avait:avoir yeux:œil les:le la:le des:de aux:à "
          "enfants:enfant choses:chose vont:aller va:aller",
    "de": "ist:sein sind:sein war:sein waren:sein bin:sein hat:haben hatte:haben wird:werden wurde:werden das:der "
          "die:der den:der dem:der kinder:kind männer:mann frauen:frau ging:gehen besten:gut",
    "es": "es:ser son:ser era:ser fue:ser ha:haber han:haber había:haber los:el las:el la:el una:un niños:niño "
          "cosas:cosa fueron:ser iba:ir",
}

# Valence of opinion words on a -4..4 scale.
VALENCE = {
    "good": 1.9, "great": 3.1, "excellent": 2.7, "wonderful": 2.7, "love": 3.2, "loved": 2.9, "happy": 2.7,
    "best": 3.2, "amazing": 2.8, "fantastic": 2.6, "perfect": 2.7, "nice": 1.8, "enjoy": 2.2, "delightful": 2.8,
    "superb": 3.1, "bad": -2.5, "terrible": -2.1, "awful": -2.0, "horrible": -2.5, "hate": -2.7, "worst": -3.1,
    "sad": -2.1, "poor": -2.1, "disappointing": -2.2, "broken": -2.1, "angry": -2.3, "useless": -1.8,
    "disaster": -3.1, "ugly": -2.3, "fail": -2.5, "gut": 1.9, "schlecht": -2.5, "bon": 1.9, "mauvais": -2.5,
    "bueno": 1.9, "malo": -2.5,
}

NEGATORS = ("not", "no", "never", "none", "neither", "nor", "without", "nicht", "kein", "keine", "nie", "ohne",
            "pas", "jamais", "sans", "nunca", "sin", "ni")

# Intensity words: positive raises, negative dampens the following opinion word.
BOOSTERS = {
    "very": 0.293, "extremely": 0.293, "really": 0.293, "so": 0.293, "more": 0.293, "most": 0.293, "sehr": 0.293,
    "très": 0.293, "muy": 0.293, "slightly": -0.293, "somewhat": -0.293, "barely": -0.293, "kaum": -0.293, "peu": -0.293,
    "poco": -0.293,
}

CONTRAST_WORDS = ("but", "aber", "mais", "pero")

# Polarity (-1..1) and subjectivity (0..1) for the mean-polarity variant.
def polarity_of(valence: dict[str, float]) -> dict[str, tuple[float, float]]:
    return {w: (round(v / 4.0, 4), round(min(1.0, 0.4 + abs(v) / 8.0), 4)) for w, v in valence.items()}


POLARITY = polarity_of(VALENCE)

# Everyday words that never count as difficult.
EASY_WORDS = tuple(
    "about after again air also always animal another answer any around ask away back because before began below "
    "better between big book both boy came carry change children city close come country cut day different does "
    "done door down draw each earth easy eat end even ever every example eye face family far father feet few find "
    "first follow food form found friend girl give good great group grow hand hard head hear help here high home "
    "house important into keep kind know land large last late learn left letter life light like line list little "
    "live long look made make many mean mother mountain move much music must name near never new next night number "
    "often old once only open other over page paper part people picture place plant play point put question read "
    "thing into over under being having then than".split())

# Names known to the entity recogniser (lower case).
GAZETTEER = {
    "mit license": "LAW", "apache license": "LAW", "creative commons": "ORG", "united states": "GPE",
    "new york": "GPE", "european union": "ORG", "united nations": "ORG", "natural language processing": "WORK",
    "san francisco": "GPE", "los angeles": "GPE", "public domain": "LAW", "all rights": "LAW",
}

LEXICON_SCHEMA = "lang STRING, word STRING, is_stop BOOLEAN, lemma STRING, upos STRING"


def stop_words(lang: str) -> list[str]:
    return sorted({w for ws in FUNCTION_WORDS.get(lang, {}).values() for w in ws.split()})


def lexicon_rows() -> list[tuple[str, str, bool, str | None, str | None]]:
    """One row per (language, word): stop flag, dictionary form and part of speech."""
    rows: dict[tuple[str, str], list] = {}
    for lang, groups in FUNCTION_WORDS.items():
        for upos, words in groups.items():
            for word in words.split():
                rows.setdefault((lang, word), [True, None, upos])
    for lang, pairs in IRREGULAR_LEMMAS.items():
        for pair in pairs.split():
            form, lemma = pair.split(":")
            rows.setdefault((lang, form), [False, None, None])[1] = lemma
    return [(lang, word, *vals) for (lang, word), vals in sorted(rows.items())]


def lexicon(spark: SparkSession) -> DataFrame:
    """The default lexicon as a local table (a few hundred rows)."""
    return local_table(spark, lexicon_rows(), LEXICON_SCHEMA)


def lemma_pairs() -> list[tuple[str, str, str]]:
    return [(lang, word, lemma) for lang, word, _, lemma, _ in lexicon_rows() if lemma]

# Suffixes that decide the part of speech of an unlisted word, in order of trial.
UPOS_SUFFIXES = (
    ("en", "ADV", ("ly",)), ("en", "VERB", ("ing", "ed")), ("en", "ADJ", ("ble", "ful", "ous")),
    ("fr", "ADV", ("ment",)), ("fr", "VERB", ("er", "ir", "ez")), ("fr", "ADJ", ("eux", "elle")),
    ("de", "ADJ", ("lich", "ig")), ("de", "VERB", ("en", "te")),
    ("es", "ADV", ("mente",)), ("es", "ADJ", ("ado", "ido")), ("es", "VERB", ("ar", "er", "ir")),
)

PUNCTUATION = tuple(".,;:!?\"'()[]{}-–—…«»‘’“”¿¡")

# Patterns of the entity recogniser, tried in this order at every position.
ENTITY_PATTERNS = (
    ("EMAIL", r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("URL", r"https?://[^\s<>\"]+"),
    ("DATE", r"[0-9]{4}-[0-9]{2}-[0-9]{2}"),
    ("MONEY", r"[$€£] ?[0-9]+(?:[.,][0-9]+)*"),
    ("PERCENT", r"[0-9]+(?:\.[0-9]+)? ?%"),
)
MIXED_WORD_PATTERN = r"[\p{L}\p{N}]*\p{L}[\p{L}\p{N}]*"
NUMBER_PATTERN = r"\p{N}+(?:[.,]\p{N}+)*"
