"""Word lists and limits that define what the rules report."""

from __future__ import annotations

# Limits.
SENTENCE_WORDS = 25
INSTRUCTION_WORDS = 20
PARAGRAPH_SENTENCES = 6
NOUN_RUN = 3
BLOCK_CHARS = 1500
BLOCK_TARGET_WORDS = 120
FILE_CHARS = 40_000
NEAR_FRACTION = 0.975
LINE_COLUMNS = 150
COMMENT_CHARS = 120
COMMENT_LINES = 14
NEAR_DUPLICATE_SHARE = 0.95
STREAK_TURNS = 4
STREAK_GAP_SECONDS = 300
QUOTE_CHARS = 60
NAME_LETTERS = 8
NAMES_PER_TEXT = 40
REPAIR_ROUNDS = 4

# Closed word classes.
CLASSES: dict[str, str] = {
    "article": "a an the",
    "determiner": "this that these those each every any no some another other which whichever either neither both several many few all "
    "its their our my your his her whose",
    "conjunction": "and or but so because though although if unless since while whereas",
    "preposition": "of in on at to for with from by into onto under over per as than through against between among about after before "
    "during without within across below above behind beside beyond near upon until toward towards along around via despite versus off out up down",
    "auxiliary": "is are was were be been being am has have had does do did can could will would shall may might must should",
    "adverb": "still already only never always also too here there now then again once twice rather quite very just even soon later instead however therefore",
    "pronoun": "it they them we us you he him she something anything nothing everything",
    "clause-subject": "it they he she we you this that these those nothing everything nobody the a an",
    "finite-verb": "is are was were has have had does do did can cannot must will makes make means gives gets goes comes stays keeps needs "
    "wants says reads holds owns carries fires runs works costs counts leaves starts stops takes tells turns lives looks sits sends renders answers "
    "reports names breaks ends fits fails passes applies returns sets adds drops moves calls opens closes splits joins emits writes prints expands",
    "subordinator": "if when whenever where wherever while because although though unless since after before until once whether provided assuming given for",
    "splice-conjunction": "and but so yet then",
    "subordinator-conjunction": "and but so or yet",
    "dangling": "and or but so yet then the a an to of in on at by for from with than rather that which who when while where because if is are "
    "was were as into over under per",
    "be": "is are was were be been being am",
    "have": "has have had",
}


def class_words(name: str) -> list[str]:
    return CLASSES[name].split()


# Modals, and the words that keep their sense.
MODALS = {"should": "must", "shall": "must", "could": "can", "might": "can", "would": "will"}
# Contractions by their endings, and those that follow no ending.
CONTRACTION_ENDINGS = {"n't": " not", "'re": " are", "'ve": " have", "'ll": " will"}
IRREGULAR_CONTRACTIONS = {"can't": "cannot", "won't": "will not", "shan't": "must not", "it's": "it is", "that's": "that is", "i'm": "I am", "let's": "let us", "wouldn't": "would not", "shouldn't": "must not", "couldn't": "cannot", "mightn't": "cannot"}
# Deflections.
BLAME_PHRASES = [
    "pre-existing", "preexisting", "not my fault", "not my problem", "not mine to fix", "not my responsibility", "worth your attention",
    "flagging this for you", "flagging this here", "left as-is", "someone should", "out of scope", "not caused by my change", "not caused by my diff",
    "you may want to", "that predates this session", "predates this session", "this was existing code", "i only copied it", "git blame shows",
    "not related to my change", "unrelated to my diff",
]
# Decisions handed to the reader.
DEFERRALS = [
    "let me know", "your call", "up to you", "say the word", "just say", "tell me which", "tell me what you", "tell me if you", "tell me whether you",
    "waiting on you", "waiting for you to", "if you want me to", "want me to", "would you like me to", "do you want me to", "shall i", "should i proceed",
    "still needs work", "i won't", "i'm not going to", "i won't touch", "i will not touch", "and i'll pick", "and i will pick", "and i'll land", "or say",
]
# First bytes of executable files.
EXECUTABLE_HEADS = [
    ("7F454C46", "ELF"), ("FEEDFACE", "Mach-O"), ("FEEDFACF", "Mach-O"), ("CEFAEDFE", "Mach-O"), ("CFFAEDFE", "Mach-O"), ("CAFEBABE", "Mach-O universal"), ("4D5A", "PE"),
]
# Irregular verbs of the form tests (base, past, participle).
VERBS = [
    ("be", "was", "been"), ("become", "became", "become"), ("begin", "began", "begun"), ("break", "broke", "broken"), ("bring", "brought", "brought"),
    ("build", "built", "built"), ("buy", "bought", "bought"), ("catch", "caught", "caught"), ("choose", "chose", "chosen"), ("come", "came", "come"),
    ("cut", "cut", "cut"), ("do", "did", "done"), ("draw", "drew", "drawn"), ("fall", "fell", "fallen"), ("find", "found", "found"), ("get", "got", "got"),
    ("give", "gave", "given"), ("go", "went", "gone"), ("hold", "held", "held"), ("keep", "kept", "kept"), ("know", "knew", "known"), ("leave", "left", "left"),
    ("lose", "lost", "lost"), ("make", "made", "made"), ("put", "put", "put"), ("read", "read", "read"), ("run", "ran", "run"), ("see", "saw", "seen"),
    ("send", "sent", "sent"), ("set", "set", "set"), ("show", "showed", "shown"), ("take", "took", "taken"), ("tell", "told", "told"), ("write", "wrote", "written"),
]
# Base verbs that open an instruction.
INSTRUCTION_VERBS = "add apply build call change check choose close copy delete do find get give go install keep make move open press put read remove run save select send set start stop take tell turn use write".split()
