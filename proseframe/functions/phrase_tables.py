"""Phrase and pattern tables of the rules, plain values alone."""

from __future__ import annotations

# Punts, as (kind, pattern).
PUNTS = [
    ('disowned', '(?i)\\b(?:not|neither)\\s+(?:mine|ours|my own)\\s+to\\s+fix\\b'),
    ('disowned', '(?i)\\bnot\\s+(?:my|our)\\s+(?:problem|job|responsibility)\\b'),
    ('handed back', '(?i)\\bworth\\s+your\\s+attention\\b'),
    ('handed back', '(?i)\\bflagging\\s+(?:it|this|these|them|that)?\\s*(?:for|to)\\s+you\\b'),
    ('handed back', '(?i)\\bsomeone\\s+should\\s+(?:fix|look|clean|deal)\\b'),
    ('handed back', '(?i)\\byou\\s+(?:may|might|could)\\s+want\\s+to\\s+(?:fix|look|check|clean)\\b'),
    ('left in place', '(?i)\\bleft\\s+(?:it|them|that|these|those)\\s+(?:as[- ]is|alone|unfixed|broken|red)\\b'),
    ('left in place', '(?i)\\bleaving\\s+(?:it|them|that|these|those)\\s+(?:as[- ]is|alone|unfixed|broken|red)\\b'),
    ('left in place', "(?i)\\bI\\s+(?:did\\s+not|didn['’]t)\\s+fix\\b"),
    ('excused', '(?i)\\bunasked\\b'),
    ('excused', '(?i)\\bout\\s+of\\s+scope\\b'),
    ('excused', '(?i)\\boutside\\s+(?:the|my|our)\\s+scope\\b'),
    ('excused', '(?i)\\bnot\\s+caused\\s+by\\s+(?:my|this|the)\\s+change\\b'),
    ('excused', "(?i)\\bpre-?existing\\b[^.!?\\n]{0,80}\\b(?:so|and)\\s+(?:I|we)\\s+(?:did\\s+not|didn['’]t|left|have\\s+not|haven['’]t)\\b"),
    ('attributed', '(?i)\\b(?:two|three|first)\\s+things?\\s+to\\s+establish\\b'),
    ('attributed', '(?i)\\bwhether\\s+(?:master|main|the\\s+base\\s+branch)\\s+is\\s+(?:also\\s+)?(?:red|failing|broken)\\b'),
    ('attributed', '(?i)\\b(?:establish|determine|work\\s+out|figure\\s+out)\\s+(?:whether|if|who)\\s+(?:I|we|this\\s+PR|my\\s+change)\\b'),
    ('authorship', "(?i)\\bnot\\s+(?:this\\s+PR|my\\s+change|mine)['’]?s?\\s+(?:to\\s+)?(?:fault|failure|problem)\\b"),
    ('authorship', '(?i)\\b(?:fails|red|broken|failing)\\s+on\\s+(?:master|main|the\\s+base\\s+branch)\\s+too\\b[^.!?\\n]{0,60}\\b(?:so|therefore)\\b'),
    ('authorship', "(?i)\\bI\\s+(?:did\\s+not|didn['’]t)\\s+(?:break|cause)\\s+(?:it|this|that)\\b"),
    ('asks leave', '(?i)\\bwant\\s+me\\s+to\\b[^.!?\\n]*\\?'),
    ('asks leave', '(?i)\\bwould\\s+you\\s+like\\s+me\\s+to\\b[^.!?\\n]*\\?'),
    ('asks leave', '(?i)\\bshall\\s+I\\b[^.!?\\n]*\\?'),
    ('asks leave', '(?i)\\bshould\\s+I\\b[^.!?\\n]*\\?'),
    ('asks leave', '(?i)\\bdo\\s+you\\s+want\\s+me\\s+to\\b[^.!?\\n]*\\?'),
    ('asks leave', "(?i)\\blet\\s+me\\s+know\\s+if\\s+you\\s*(?:'|’)?d?\\s*(?:would\\s+)?like\\b"),
    ('asks leave', "(?i)\\bI\\s+can\\s+\\S[^.!?\\n]{0,60}\\s+if\\s+you\\s*(?:'|’)?d?\\s*(?:would\\s+)?like\\b"),
    ('asks leave', '(?i)\\bsay\\s+the\\s+word\\b'),
    ('asks leave', '(?i)\\b(?:can|may|could)\\s+I\\s+(?:go\\s+ahead\\s+and\\s+)?(?:fix|repair|patch|change|edit|touch|work\\s+on)\\b[^.!?\\n]*\\?'),
    ('asks leave', '(?i)\\b(?:ok|okay|alright|fine)\\s+(?:if\\s+I|to|for\\s+me\\s+to)\\s+(?:fix|repair|patch|change|edit|touch|work\\s+on|proceed|go\\s+ahead)\\b[^.!?\\n]*\\?'),
    ('asks leave', "(?i)\\b(?:tell\\s+me|let\\s+me\\s+know)\\s+(?:if|whether)\\s+you\\s*(?:'|’)?d?\\s*(?:want|need|would\\s+like)\\b"),
    ('awaits leave', '(?i)\\bthe\\s+user\\s+(?:has\\s+)?(?:authori[sz]ed|approved|permitted|allowed|cleared|okayed|signed\\s+off\\s+on)\\s+(?:fixing|repairing|changing|editing|touching|work(?:ing)?\\s+on|me\\s+to|you\\s+to|the\\s+fix|a\\s+fix)\\b'),
    ('awaits leave', '(?i)\\boff[- ]limits\\s+(?:unless|until|without)\\b'),
    ('awaits leave', "(?i)\\bI(?:\\s+am|['’]m)\\s+(?:asking|checking\\s+with)\\s+the\\s+user\\b"),
    ('awaits leave', "(?i)\\b(?:needs?|needing|requires?|wait(?:s|ing)?\\s+(?:for|on))\\s+(?:the\\s+user['’]?s?|your)\\s+(?:permission|approval|authori[sz]ation|go-?ahead|OK|okay|sign-?off)\\b"),
]

# What pardons a sentence, one pattern each.
PARDONS = [
    '(?i)\\b(?:fixed|repaired|patched|corrected)\\s+(?:it|them|that|those|these|anyway|here|now|in)\\b',
    '(?i)\\balready\\s+(?:fixed|repaired|pushed|landed|corrected)\\b',
    '(?i)\\b(?:pushed|landed|committed)\\s+(?:the\\s+)?fix\\b',
    '(?i)\\bfix(?:ed)?\\s+(?:it\\s+)?in\\s+(?:this|the\\s+same)\\s+(?:turn|commit|change|PR|pull\\s+request)\\b',
    '(?i)\\b(?:limit|restrict|confine|narrow|keep)\\s+(?:the\\s+|your\\s+|this\\s+)?(?:search|exploration|survey|sweep|lookup|investigation)\\b',
    '(?i)\\b(?:out\\s+of|outside\\s+(?:the|its|your|this))\\s+scope\\s+(?:for|of)\\s+(?:this|the|your)\\s+(?:search|exploration|survey|sweep|lookup|investigation)\\b',
    '(?i)\\bread-only\\s+(?:search|exploration|survey|sweep|lookup|brief|pass)\\b',
]

# Words that a text can do without, as (surface, word).
FILLERS = [
    ('both', 'actually'),
    ('both', 'basically'),
    ('both', 'essentially'),
    ('both', 'fundamentally'),
    ('both', 'simply'),
    ('both', 'obviously'),
    ('both', 'clearly'),
    ('both', 'of course'),
    ('both', 'in fact'),
    ('both', 'indeed'),
    ('both', 'really'),
    ('both', 'very'),
    ('both', 'quite'),
    ('both', 'somewhat'),
    ('both', 'fairly'),
    ('both', 'just'),
    ('both', 'it is worth noting that'),
    ('both', 'please note that'),
    ('both', 'needless to say'),
    ('both', 'at the end of the day'),
    ('both', 'for the purposes of'),
    ('both', 'with respect to'),
    ('message', 'it is important to note that'),
    ('both', 'note that'),
]

# Phrases with a shorter form, as (surface, phrase, instead).
SWAPS = [
    ('both', 'in order to', 'to'),
    ('both', 'due to the fact that', 'because'),
    ('both', 'in the event that', 'if'),
    ('both', 'for the purpose of', 'for'),
    ('both', 'a large number of', 'many'),
    ('both', 'at this point in time', 'now'),
    ('both', 'is able to', 'can'),
    ('both', 'has the ability to', 'can'),
    ('both', 'make use of', 'use'),
    ('both', 'take into account', 'consider'),
    ('both', 'the reason is because', 'because'),
    ('both', 'in spite of the fact that', 'although'),
    ('both', 'a sufficient number of', 'enough'),
    ('both', 'prior to', 'before'),
    ('both', 'subsequent to', 'after'),
    ('both', 'in the near future', 'soon'),
    ('both', 'on a regular basis', 'regularly'),
    ('both', 'whether or not', 'whether'),
    ('message', '— and', ','),
    ('message', '— but', ', but'),
    ('message', '— so', ', so'),
    ('message', '— which', ', which'),
    ('message', 'that being said', 'but'),
]

# Wording that tells of a past state, as (rule, pattern, instead).
TELLS = [
    ('tombstones/date', '(?i)\\s*\\b(?:on|as of|since)\\s+(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}\\b', ''),
    ('tombstones/date', '(?i)\\s*\\(\\s*(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}\\s*\\)', ''),
    ('tombstones/date', '(?i)\\(\\s*(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}\\s*[,;:]\\s*', '('),
    ('tombstones/date', '(?i)\\s*[,;]?\\s*\\b(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}\\s*\\)', ')'),
    ('tombstones/date', '(?i)\\s*\\b(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}\\b', ''),
    ('tombstones/date', '(?i)\\b(copyright(?:\\s*(?:\\(c\\)|©))?)\\s+(?:19|20)[0-9]{2}(?:\\s*[-–,]\\s*(?:19|20)[0-9]{2})*\\b', '$1'),
    ('tombstones/change-reference', '(?i)\\s*\\(?\\b(?:see\\s+)?(?:pr|pull request|issue|ticket|commit)\\s+#?[0-9]+\\)?', ''),
    ('tombstones/then-and-now-contrast', '(?i)\\s*\\binstead of (?:the )?(?:old|former|previous|legacy)\\s+\\S+', ''),
    ('tombstones/position-reference', '(?i)\\s*\\b(?:as mentioned|as noted|as described) (?:above|below)\\b[,]?', ''),
    ('tombstones/position-reference', '(?i)\\s*\\bsee (?:above|below)\\b[^.]*', ''),
    ('tombstones/hedged-time', '(?i)\\s*\\bfor now\\b[,]?', ''),
    ('tombstones/hedged-time', '(?i)\\s*\\bcurrently\\b[,]?', ''),
    ('tombstones/hedged-time', '(?i)\\s*\\bwill be\\b[^.]*\\b(?:later|soon|eventually|someday|in (?:a|the) future)\\b[^.]*', ''),
    ('tombstones/unstated-value', '(?i)\\s*\\bis (?:tbd|to be determined)\\b', ' has no set value'),
    ('tombstones/shrug', '(?i)\\s*\\bfor some reason\\b[,]?', ''),
    ('tombstones/shrug', '(?i)\\s*\\bdo not ask (?:why|how)\\b[^.]*', ''),
    ('tombstones/shrug', '(?i)\\s*\\bobviously\\b', ''),
    ('tombstones/unexplained-workaround', '(?i)\\ba hack around\\b', 'a workaround for'),
    ('tombstones/unexplained-workaround', '(?i)\\ba magic number\\b', 'a constant'),
]

# Phrases that are reported and not rewritten, one each.
FLAGGED = [
    'fixme',
    'somehow',
    'no longer',
]

# Phrases that are reported in comments and not rewritten, one each.
VAGUE_COMMENTS = [
    'as mentioned above',
    'as mentioned below',
    'see above',
    'see below',
    'for now',
    'currently',
    'used to',
    'no longer',
    'will be',
    'tbd',
    'obviously wrong',
    'hack',
    'for some reason',
    'magic number',
    'do not ask',
]
