"""Fixed values that results depend on: word lists, characters, patterns and texts of the retrieval rules."""

# Letters and marks of Arabic script.
ARABIC = "؀-ۿ"
DIACRITICS = "[ً-ْٰـ]"
#: The same marks, one by one.
MARKS = "".join(map(chr, range(0x64B, 0x653))) + "\u0670\u0640"
ARABIC_DIGITS, DIGITS = "٠١٢٣٤٥٦٧٨٩", "0123456789"
LETTERS_FROM, LETTERS_TO = "أإآٱىةؤئ", "اااايهوي"
ARABIC_SHARE = 0.4
#: Characters that compatibility composition (NFKC) never changes, whatever stands next to them.
LATIN = r"\t\n\x0B\f\r\x20-\x7E¡-§©«®°±¶·»¿-ıĴ-ľŁ-ňŊ-žƀ-ƒ‐‒-―‘-‟†‡•€"
STABLE = LATIN + "؀-ْٖ-ٴٹ-ۿ"
#: A lone letter of this script before others and a word; runs of alef and lam.
LONE_LETTER = r"(?<![؀-ۿ])([؀-ۿ]) (?=(?:[؀-ۿ] )*[؀-ۿ]{2})"
ALEF, LAM = "ا", "ل"

# Tokens and words without meaning of their own.
TOKEN = "[a-zA-ZÀ-ÿ]+|[؀-ۿ]+|\\d+"
STOPWORDS_FR = (
    "le la les de des du un une et ou a au aux en dans par pour sur sous avec sans ce cet cette ces qui que quoi dont est sont etre "
    "il elle ils elles son sa ses leur leurs ne pas plus se y d l s n c j m t"
).split()
STOPWORDS_AR = "من في علي الي عن مع هذا هذه ذلك التي الذي ما لا ان او كل بعد قبل عند هو هي به له".split()
STOPWORDS = STOPWORDS_FR + STOPWORDS_AR
CONTENT_STOP = (
    "le la les de des du un une et ou a au aux en dans par pour sur que qui quel quelle quels est sont il elle mon ma mes son sa ses ce "
    "cette peut doit combien comment avec sans plus pas faire fait quelqu chaque tous tout après avant entre"
).split()

# Noise lines, headings of units.
NOISE = (
    r"(?m)^\s*-?\s*\d+\s*-?\s*$",
    r"(?im)^\s*BULLETIN OFFICIEL.*$",
    r"(?im)^\s*Bulletin Officiel n[°o]\s*\d+.*$",
    r"(?im)^\s*CODE DU TRAVAIL\s*$",
)
TABLE_OF_CONTENTS = "TABLE DES MATI"
UNITS = {
    "article_fr": r"(?m)^[ \t]*Article[ \t]+(\d+|premier)\b(?![ \t]*(?:ci-|ci ?dessus|ci ?dessous|du |de la |de l'|des ))",
    "article_ar": r"(?m)^[ \t]*(?:الماد[ةه][ \t]*[:\-]?[ \t]*([\d٠-٩]+)|([\d٠-٩]+)[ \t]*الماد[ةه])(?![ \t]*(?:أعلاه|أدناه|من الظهير|من القانون|من المرسوم|من هذا|من هذه))",
    "rubrique": r"(?i)\bRubrique\s+([\d.]+)",
    "circulaire": r"(?i)\bCirculaire\s+n[°o]?\s*([\d/\-]+)",
}
UNIT_GROUPS = {"rubrique": ("rubrique",), "section": ("circulaire", "article_fr")}
HEADING_FR = (r"^Article\s+", r"\b(?!\s*(ci-|du |de la |de l'|des ))")
HEADING_AR = (r"^(الماد[ةه]\s*[:\-]?\s*", r"\b|", r"\s*الماد[ةه])")

# What an answer says that has too little to go on, and what is asked of a model.
REFUSAL = "INFORMATION INSUFFISANTE"
PROMPT = """Tu es un assistant juridique. Tu reponds UNIQUEMENT a partir des passages numerotes ci-dessous.

REGLES ABSOLUES :
1. Chaque affirmation doit etre suivie de sa source entre crochets : [1], [2]...
2. N'utilise JAMAIS de connaissance exterieure aux passages, meme si tu la crois vraie.
3. Si les passages ne permettent pas de repondre, ecris exactement : {refusal}
   puis une phrase indiquant ce qui manque. N'invente aucun chiffre.
4. Reponds dans la langue de la question, en 5 phrases au maximum.

PASSAGES :
{context}

QUESTION : {question}

REPONSE :"""

# What is asked of a judge.
FAITHFULNESS = """Tu es un evaluateur rigoureux. On te donne une QUESTION,
des PASSAGES SOURCES, et une REPONSE generee.

Decoupe la REPONSE en affirmations elementaires. Pour chacune, dis si elle est
DIRECTEMENT soutenue par les PASSAGES (oui/non). Une affirmation vraie dans
l'absolu mais absente des passages compte comme NON soutenue.

Retourne uniquement du JSON :
{"affirmations": [{"texte": "...", "soutenue": true, "passage": 2}],
  "score": <nb_soutenues / nb_total>}

QUESTION: {question}
PASSAGES: {contexts}
REPONSE: {answer}
"""

# Defaults of the operators.
RRF_K, BM25_K1, BM25_B, COPY_ALERT = 60, 1.5, 0.75, 0.5
