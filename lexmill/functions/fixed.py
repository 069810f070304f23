"""Word lists, labels and constants that results depend on, as text in natural order."""

from __future__ import annotations


def _words(text: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(text.split()))


# fixed values: basic verbs, adjectives and nouns
BASIC_VERBS = _words(
    """feel see hear smell taste touch look watch listen be am is are was were seem appear become stay remain
    go come get give take make do have say tell speak eat drink sleep walk run sit stand lie live die
    love like hate want need hope wish fear worry care think know believe understand remember forget learn study
    work play help start stop finish open close turn move"""
)
BASIC_ADJECTIVES = _words(
    """good bad big small old new young hot cold warm happy sad angry tired hungry thirsty easy hard difficult
    important interesting beautiful ugly clean dirty fast slow"""
)
BASIC_NOUNS = _words("man woman child boy girl people person family friend house home school work job money time day night year")
BASIC_WORDS = tuple(dict.fromkeys(BASIC_VERBS + BASIC_ADJECTIVES + BASIC_NOUNS))

# fixed values: prepositions that earn a pattern its bonus
PREPOSITIONS = _words(
    """about above across after against along among around at before behind below beneath beside between beyond by
    down during except for from in inside into like near of off on outside over through throughout till to toward
    under until up upon with within without"""
)
ARTICLES = ("a", "an", "the")

# fixed values: weights by length and ordered bonuses of patterns
LENGTH_WEIGHTS = {2: 1.0, 3: 1.5, 4: 2.0, 5: 1.2}
PATTERN_BONUSES = (
    (r"(^| )as [\p{L}\p{N}_]+ as( |$)", 3.0),
    (r"(^| )in order to( |$)", 3.0),
    (r"(^| )as a result( |$)", 2.5),
    (r"(^| )in spite of( |$)", 2.5),
    (r"(^| )due to( |$)", 2.0),
    (r"(^| )according to( |$)", 2.0),
    (r"(^| )not only( |$)", 2.5),
    (r"(^| )would rather( |$)", 2.0),
)
MIN_FREQUENCY = {2: 3, 3: 2, 4: 1, 5: 1}

# fixed values: categories of patterns, tried in this order; the test is on letters, not on words
CATEGORY_LINK = ("연결어구", ("as a result", "in addition", "however", "therefore", "moreover", "furthermore"))
CATEGORY_PREPOSITION = ("전치사구", ("in", "on", "at", "by", "with", "for", "of"))
CATEGORY_TIME = ("시간표현", ("when", "while", "during", "before", "after", "until", "since"))
CATEGORY_CONDITION = ("조건표현", ("if", "unless", "provided", "suppose", "in case"))
CATEGORY_VERB = ("동사구", ("up", "out", "off", "on", "down", "away"))
CATEGORY_ACADEMIC = ("학술표현", ("according to", "due to", "because of", "in terms of"))
CATEGORY_OTHER = "기타표현"

# fixed values: part-of-speech sequences worth keeping
POS_SEQUENCES = (("ADP", "NOUN"), ("ADV", "ADJ"), ("VERB", "ADP"), ("ADP", "NOUN", "ADP"), ("CONJ", "ADP"), ("ADV", "CONJ"))

# fixed values: words of grammar, with their tags, for the rule-based tagger
TAGGED_WORDS = (
    ("DET", _words("the a an this that these those each every some any no another either neither")),
    ("PRON", _words("i you he she it we they me him her us them my your his its our their who whom whose which what myself itself themselves someone nobody")),
    ("AUX", _words("be am is are was were been being do does did have has had will would shall should can could may might must")),
    ("CCONJ", _words("and or but nor yet so")),
    ("SCONJ", _words("because although though while if unless when whether once whereas")),
    ("ADP", PREPOSITIONS + ("as", "out", "away", "back")),
    ("PART", ("not",)),
    ("ADV", _words("very too also just only never always often here there now then again soon rather quite however therefore")),
)
POS_OF_SUFFIX = (("ADV", ("ly",)), ("ADJ", ("ful", "less", "ous", "ive", "ible", "able", "ical", "ish", "al", "ic")), ("VERB", ("ing", "ed", "ize", "ise", "ify", "ate")))
EASY_TAGS = ("DET", "ADP", "CONJ", "PRON", "AUX", "INTJ")
SIMPLE_POS = {"NOUN": "명사", "VERB": "동사", "ADJ": "형용사", "ADV": "부사"}
OTHER_POS = "기타"

# fixed values: labels of parts of speech and the letter of each; case is left aside
POS_LETTERS = {
    "n": "noun n nn nns nnp nnps 명사",
    "v": "verb v vb vbd vbg vbn vbp vbz 동사",
    "a": "adjective adj a jj jjr jjs 형용사",
    "r": "adverb adv r rb rbr rbs 부사",
}

# fixed values: words too common to be synonyms
COMMON_SYNONYMS = _words("good bad big small make take get go come see hear feel know think say tell have be do can will would could should may might")
# fixed values: the only candidates of high quality
QUALITY_SYNONYMS = _words(
    """big small large tiny huge little good bad great poor fine nice awful happy sad glad upset joyful fast slow quick rapid
    hot cold warm cool easy hard difficult simple new old fresh recent important crucial vital significant
    beautiful pretty lovely ugly strong weak powerful rich wealthy clean dirty messy loud quiet noisy silent"""
)

# fixed values: roots
IRREGULAR_ROOTS = {
    "better": "good", "worse": "bad", "best": "good", "worst": "bad", "more": "much", "most": "much",
    "less": "little", "least": "little", "further": "far", "furthest": "far", "older": "old", "oldest": "old",
}
MORE_IRREGULAR_ROOTS = IRREGULAR_ROOTS | {"farther": "far", "farthest": "far", "elder": "old", "eldest": "old"}
ROOT_SUFFIXES = _words("ness ment tion sion ible able ical ful less ish ous ive ing ed er est ly al ic y")
SHORT_ROOT_SUFFIXES = _words("ing ed er est ly ness ment tion")

# fixed values: difficulty of words
DIGRAPHS = _words("ph th ch sh gh ck ng qu")
HARD_SUFFIXES = _words("tion sion ment ness ity ism ology graphy")
HARD_PREFIXES = _words("pre post anti auto inter trans sub super")
HARD_ROOTS = _words("duct struct spect ject port form")

# fixed values: phrasal verbs
OPTIONAL_SEPARABLE = (
    "pick up", "turn on", "turn off", "look up", "put on", "take off", "bring up", "call up", "give up",
    "set up", "clean up", "fill up", "write down", "sit down", "stand up", "wake up", "get up",
)
MANDATORY_SEPARABLE = {
    "pick": ("up", "out", "off"), "turn": ("down", "up"), "put": ("away", "back"), "take": ("apart", "down"),
    "figure": ("out",), "work": ("out",), "point": ("out",), "carry": ("out",), "bring": ("about",),
}
PARTICLES = _words("up down on off out in away back")
GAP_PRONOUNS = _words("it him her them this that these those")

# fixed values: grammar templates; the last group must end in ing where the name says V-ing
GRAMMAR_PATTERNS = (
    (r"spend\s+(?:time|money|hours?|days?|years?)\s+(\w+ing)", "spend time V-ing"),
    (r"is\s+worth\s+(\w+ing)", "be worth V-ing"),
    (r"keep\s+(?:on\s+)?(\w+ing)", "keep V-ing"),
    (r"avoid\s+(\w+ing)", "avoid V-ing"),
    (r"enjoy\s+(\w+ing)", "enjoy V-ing"),
    (r"finish\s+(\w+ing)", "finish V-ing"),
    (r"prevent\s+(\w+)\s+from\s+(\w+ing)", "prevent N from V-ing"),
    (r"stop\s+(\w+)\s+from\s+(\w+ing)", "stop N from V-ing"),
    (r"it\s+takes\s+(\w+)\s+to\s+(\w+)", "it takes N to V"),
    (r"there\s+is\s+no\s+point\s+in\s+(\w+ing)", "there is no point in V-ing"),
)
KNOWN_PHRASES = (
    r"as\s+\w+\s+as", r"in\s+order\s+to", r"as\s+a\s+result", r"on\s+the\s+other\s+hand", r"for\s+instance",
    r"in\s+spite\s+of", r"because\s+of", r"instead\s+of", r"according\s+to",
)

# fixed values: the workbook's 22 columns, in order: internal name, name in the sheet, type
WORKBOOK = (
    ("textbook_id", "교재ID", "double"), ("book_title", "교재명", "string"), ("passage_id", "지문ID", "string"), ("seq", "순서", "bigint"),
    ("passage_preview", "지문", "string"), ("word", "단어", "string"), ("base_form", "원형", "string"), ("pos", "품사", "string"),
    ("meaning_ko", "뜻(한글)", "string"), ("meaning_en", "뜻(영어)", "string"), ("synonyms", "동의어", "string"), ("antonyms", "반의어", "string"),
    ("context", "문맥", "string"), ("is_separated", "분리형여부", "boolean"), ("confidence", "신뢰도", "double"),
    ("user_db_match", "사용자DB매칭", "boolean"), ("match_type", "매칭방식", "string"), ("pattern_info", "패턴정보", "string"),
    ("contextual_meaning", "문맥적의미", "string"), ("synonym_confidence", "동의어신뢰도", "double"), ("process_method", "처리방식", "string"),
    ("inclusion_reason", "포함이유", "string"),
)
WORKBOOK_NAMES = tuple(name for name, _, _ in WORKBOOK)

# fixed values: names under which the quality check knows a column
ALIASES = {
    "word": ("단어", "원형", "word", "base_form", "original"),
    "meaning": ("뜻(한글)", "의미", "한글뜻", "meaning", "korean_meaning", "meaning_ko"),
    "context": ("문맥", "예문", "context", "sentence", "example"),
    "passage_id": ("지문ID", "passage_id", "text_id", "source_id"),
    "original_text": ("원문", "original", "found_text"),
    "type": ("유형", "type", "entry_type", "item_type"),
    "is_idiom": ("숙어여부", "is_idiom", "is_phrase", "idiom_flag"),
    "synonyms": ("동의어", "synonyms", "synonym"),
    "antonyms": ("반의어", "antonyms", "antonym"),
}
TEXT_COLUMNS = ("content", "지문", "text", "텍스트", "본문")
PHRASE_COLUMNS = ("phrase", "idiom", "expression", "text", "content", "원형")
ENCODINGS = ("utf-8", "cp949", "euc-kr", "latin1", "utf-8-sig")
MISSING_TEXTS = ("", "nan", "none")
TRUE_TEXTS = ("true", "1", "yes", "예", "y")
GENERIC_MEANING = "의 의미"
MEANING_LABELS = ("한국어 뜻:", "답변:", "의미:")

# fixed values: penalties of the quality score
PENALTIES = {"duplicates": 25, "conflicts": 20, "meanings": 25, "synonyms": 10, "contexts": 15, "accuracy": 5}

# fixed values: the issue sheet, its texts and labels; internal name to sheet name, in the order of the sheet
ISSUE_COLUMNS = {
    "issue_type": "문제유형", "severity": "심각도", "passage_id": "지문ID", "word": "단어", "idiom": "숙어", "conflicting_word": "충돌단어", "current_meaning": "현재의미",
    "problem_type": "문제유형상세", "meaning": "의미", "context": "문맥", "description": "문제설명", "recommendation": "권장사항", "analysis": "AI분석", "suggested_meaning": "제안의미", "entry_id": "행번호",
}
ISSUE_LABELS = {
    "within_passage_duplicate": "지문내중복",
    "idiom_word_conflict": "숙어-단어충돌",
    "missing_korean_meaning": "한글뜻누락/오류",
    "missing_synonyms": "동의어누락",
    "context_meaning_mismatch": "문맥-의미부적합",
    "word_meaning_mismatch": "단어-의미불일치",
}
ISSUE_TEXTS = {
    "within_passage_duplicate": "지문 %s에서 '%s' 단어가 %s번 중복됨",
    "idiom_word_conflict": "지문 %s에서 숙어 '%s'과 단일 단어 '%s'가 중복 추출됨",
    "resolve_conflict": "숙어 '%s'이 있으므로 단일 단어 '%s' 제거 권장",
    "missing_korean_meaning": "'%s'의 한글 뜻이 부적절함: %s",
    "make_meaning": "AI로 올바른 한글 뜻 생성 필요",
    "missing_synonyms": "'%s'의 동의어가 비어있음",
    "make_synonyms": "AI로 동의어 생성 권장",
    "context_meaning_mismatch": "'%s'의 한글 뜻 '%s'이 문맥에 부적절함",
    "word_meaning_mismatch": "'%s'의 한글 뜻 '%s'이 원형 단어의 의미와 불일치",
}

# fixed values: built-in parts of the external word lists, and what the last list of easy words adds to stop words and basic words
OXFORD_WORDS = _words(
    "about above across act active activity add afraid after again against age ago agree air all alone along already although always among angry animal answer any "
    "anyone anything appear area argue arm army around arrive art article ask attack aunt autumn away"
)
COCA_WORDS = _words(
    "the be to of and a in that have i it for not on with he as you do at this but his by from they she or an will my one all would there their what so up out if "
    "about who get which go me when make can like time no just him know take people into year your good some could them see other than then now look only come its "
    "over think also back after use two how our work first well way even new want because"
)
GSL_WORDS = _words("the be to of and a in that have i it for not on with he as you do at this but his by")
EXTERNAL_LISTS = {
    "oxford": ("oxford_3000.txt", OXFORD_WORDS),
    "coca": ("coca_2000.txt", COCA_WORDS),
    "gsl": ("gsl_2000.txt", tuple(dict.fromkeys(BASIC_WORDS + GSL_WORDS))),
}
EASY_EXTRA = _words("the a an this that these those good bad big small new old young make take get go come see know")

# fixed values: marks of refined rows
REFINED, REFINED_WITH_FORMS = "개선된정제_하이브리드", "개선된정제_AI원형필터링"
CHANGED, SAME = "✓ 개선됨", "동일"

# fixed values: title of texts without metadata, most rows of a spreadsheet
DEFAULT_TITLE = "Advanced Vocabulary"
SHEET_ROWS = 1_048_575
