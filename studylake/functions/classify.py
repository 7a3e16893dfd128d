"""Classifiers of short texts by phrases: the kind of a question, the intent of a message."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from studylake.functions.text import nfkc, without_accents

# Fixed values of the message classifier, folded.
COURTESY = (
    "hi", "hii", "hey", "hello", "helo", "yo", "good morning", "good afternoon", "good evening", "good night", "how are you", "how r u", "how are u",
    "whats up", "what s up", "sup", "thanks", "thank you", "thx", "ty", "thank u", "ok", "okay", "k", "cool", "nice", "great", "bye", "goodbye",
    "see you", "good bye", "sorry", "no", "yes", "yep", "nope", "salut", "bonjour", "bonsoir", "coucou", "allo", "ca va", "comment ca va",
    "comment vas tu", "merci", "merci beaucoup", "de rien", "d accord", "daccord", "ok merci", "au revoir", "bonne nuit", "a bientot", "pardon",
    "oui", "non", "مرحبا", "اهلا", "اهلا وسهلا", "السلام عليكم", "سلام", "صباح الخير", "مساء الخير", "كيف حالك", "كيفك", "شكرا", "شكرا جزيلا", "تمام",
    "حسنا", "مع السلامه", "وداعا", "نعم", "لا", "عفوا",
)
PLANNING = (
    "my schedule", "my plan", "my revision", "my study plan", "my timetable", "study plan", "revision plan", "what should i study",
    "what should i revise", "should i study", "should i revise", "what should i do next", "what do i do next", "where do i start",
    "where should i start", "what s next", "whats next", "am i ready", "am i behind", "am i on track", "how am i doing", "days until", "days till",
    "days left", "days to go", "how long until", "how long do i have", "what s due", "whats due", "what is due", "plan my", "organise my",
    "organize my", "help me plan", "time to study", "how much time should i", "mon planning", "mon emploi du temps", "emploi du temps",
    "mon plan de revision", "mon programme de revision", "plan de revision", "programme de revision", "que dois je reviser",
    "qu est ce que je dois reviser", "je dois reviser quoi", "par quoi commencer", "par ou commencer", "je suis pret", "suis je pret",
    "je suis en retard", "ou j en suis", "combien de jours avant", "combien de jours il me reste", "combien de temps il me reste", "organise moi",
    "aide moi a planifier", "quoi reviser", "برنامجي", "جدولي", "خطتي", "جدول الدراسه", "خطه المراجعه", "برنامج المراجعه", "ماذا ادرس",
    "ماذا اراجع", "من اين ابدا", "هل انا جاهز", "هل انا متاخر", "كم يوم بقي", "كم بقي من الوقت", "كم يوما تبقي", "نظم لي", "ساعدني في التخطيط",
    "ما التالي",
)
CAPABILITY = (
    "what can you do", "what do you do", "what can you help", "can you help me with", "who are you", "what are you", "how do you work",
    "how does this work", "what is this", "what are you for", "how can you help", "can you help", "what subjects", "which subjects", "what topics",
    "que peux tu faire", "que sais tu faire", "qui es tu", "c est quoi", "comment ca marche", "tu peux m aider", "peux tu m aider",
    "tu sers a quoi", "quelles matieres", "quelle matiere", "ماذا تفعل", "من انت", "ما هذا", "كيف تعمل", "هل يمكنك مساعدتي", "بماذا تساعدني",
    "ما هي المواد",
)
COURTESY_WORDS, MESSAGE_WORDS = 4, 30

EDGE = r"\b"
# Fixed values of the question classifier: patterns, and Arabic phrases without spaces.
ESSAY_HEADER = r"\bsujets?\s*[:：]|\b(?:premier|premi[èe]re|deuxi[èe]me|troisi[èe]me|quatri[èe]me)\s+sujet\b|\bdissertation\b|\bproduction\s+[ée]crite\b|\btopics?\s*[:：]|\bessay\b"
ESSAY_ORDER = (
    r"\bpartagez-vous\b|\bdiscutez\b|\bdissertez\b|\bce jugement\b|\bcette citation\b|\bcette affirmation\b|\bce point de vue\b|\bprobl[ée]matiques?\b"
    r"|\bque pensez-vous\b|\b[àa] votre avis\b|\br[ée]digez\b|\bessai argumentatif\b|\bexpliquez ce (?:jugement|texte|propos|point)\b"
    r"|\bexpliquez cette (?:id[ée]e|citation|affirmation|pens[ée]e)\b|\bdiscuss\b|\bto what extent\b|\bdo you agree\b|\bin your opinion\b|\bthe problematic\b"
    r"|\bexplain this (?:judg\w+|statement|idea|saying|quotation|text)\b|\bwrite an? (?:essay|composition|paragraph|argumentative\s+\w+)\b"
)
DOCUMENT = (
    r"\b(?:le|la|les|ce|cet|cette|ces|du|de la|des|au|aux|dans le|d[’']apr[èe]s le)\s+(?:texte|document|extrait|passage|po[èe]me|paratexte|corpus|caricature|strophe|vers)s?\b"
    r"|\bl[’'](?:extrait|auteur|article|image)\b|\blignes?\s*\d|\bl\.\s*\d|\bparagraphes?\b"
    r"|\b(?:the|this|that|these|those|your)\s+(?:text|passage|extract|document|poem|story|paragraph|author)s?\b|\b(?:the|this|that)\s+articles?\b|\blines?\s*\d|\baccording to the\b"
)
ARABIC_DOCUMENT_WORD = r"(?<!\p{L})(?:النص|النصوص|السطر|الاسطر|البيت|المقطع)(?!\p{L})"
POINTING = r"\bci-dessus\b|\bci-dessous\b|\bci-contre\b|\bcelui-ci\b|\bcelle-ci\b|\bcette question\b|\bcet exercice\b|\bthe above\b|\bthe following\b|\bthis question\b|\bthis exercise\b"
ARABIC_ESSAY = (
    "الموضوع", "اشرحهذاالقول", "اشرحهذاالحكم", "ناقشهذاالقول", "ناقشهذاالحكم", "اشرحهذاالراي", "حللهذاالقول", "اشرحهذاالنص", "ناقشهذاالنص",
    "حللهذاالنص", "عالجاحد", "اختراحد", "ابدرايك", "فيضوءماتقدم", "اكتبمقالة", "دافععن", "ناقش",
)
ARABIC_DOCUMENT = ("المستند", "القصيدة", "الابيات", "الوثيقة", "الفقرة", "الرسمالبياني", "بالعودةالي", "فيضوءالمستند", "النصالاتي", "النصالتالي")
ARABIC_POINTING = ("الاتي", "اعلاه", "ادناه", "هذاالسؤال", "هذاالتمرين", "المذكور")


def holds_any(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in phrases))


def fold_message(text: Column) -> Column:
    """Compatibility forms, no accents or Arabic marks, alef and others as one letter, lower case, punctuation and white space as one space."""
    plain = F.translate(F.regexp_replace(without_accents(nfkc(text)), "[\\u0640\\u064B-\\u0652\\u0670]", ""), "أإآىة", "ااايه")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(plain), "[!?.,;:…\"'«»()\\[\\]-]", " "), "(?U)\\s+", " "))


def intent(folded: Column) -> Column:
    """smalltalk, planning, capability or curriculum for a folded message; long messages are about the curriculum whatever they hold."""
    words = F.size(F.split(folded, " "))
    return (
        F.when(folded == "", "smalltalk").when((words <= COURTESY_WORDS) & folded.isin(*COURTESY), "smalltalk").when(words > MESSAGE_WORDS, "curriculum")
        .when(holds_any(folded, PLANNING), "planning").when(holds_any(folded, CAPABILITY), "capability").otherwise("curriculum")
    )


def fold_question(text: Column) -> Column:
    plain = F.translate(F.regexp_replace(nfkc(text), "[\\u0640\\u064B-\\u0652\\u0670]", ""), "أإآٱى«»“”‘’", 'ااااي""""""')
    return F.lower(F.trim(F.regexp_replace(plain, "(?U)\\s+", " ")))


#: The letters that alternatives of the patterns above begin with.
OPENING = {ESSAY_HEADER: "spdqte", ESSAY_ORDER: "pdcqàareitw", DOCUMENT: "lcdapty", POINTING: "ct"}


def at_words(pattern: str) -> str:
    """A pattern whose alternatives each begin at a word's edge, for folded texts: one look at the letter and one at the edge for all of them."""
    return f"(?=[{OPENING[pattern]}])\\b(?:{pattern.removeprefix(EDGE).replace('|' + EDGE, '|')})"


def question_kind(folded: Column) -> Column:
    """kind (essay, comprehension, concept) and confidence of a folded question; the first rule that holds decides."""
    tight = F.regexp_replace(folded, " ", "")
    found = lambda p: folded.rlike(at_words(p))
    answer = lambda kind, sure="high": F.struct(F.lit(kind).alias("kind"), F.lit(sure).alias("confidence"))
    return (
        F.when(found(ESSAY_HEADER) | holds_any(tight, ARABIC_ESSAY) | found(ESSAY_ORDER), answer("essay"))
        .when(found(DOCUMENT) | folded.rlike(ARABIC_DOCUMENT_WORD) | holds_any(tight, ARABIC_DOCUMENT), answer("comprehension"))
        .when(found(POINTING) | holds_any(tight, ARABIC_POINTING), answer("concept", "low")).otherwise(answer("concept"))
    )
