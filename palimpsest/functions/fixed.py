"""Patterns, word lists, formats and constants that results depend on.

Patterns are Java regular expressions. ``(?U)`` makes classes and boundaries
Unicode-aware, ``i`` ignores case, ``s`` lets a dot match newlines, ``m`` anchors
at lines.
"""

from __future__ import annotations

# --- fixed values: protected regions, in order of application -------------------------------
OPEN, CLOSE, ESCAPE = "⟦", "⟧", "​"
REGIONS = (
    ("code_fence", r"(?Us)```.*?```"),
    ("json_block", r"(?Us)(?<![\w⟦])\{(?:[^{}]++|\{[^{}]*+\})*+\}(?!\w)"),
    ("xml_block", r"(?Us)<([A-Za-z][\w.-]*)(?:\s[^<>]*)?>.*?</\1>"),
    ("inline_code", r"(?U)`[^`\n]+`"),
    ("url", r"""(?U)\b(?:https?|ftp|file)://[^\s<>"')\]]+"""),
    ("email", r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b"),
    ("win_path", r"""(?U)\b[A-Za-z]:[\\/][^\s:*?"<>|]+"""),
    ("unc_path", r"""(?U)\\\\[\w.-]+\\[^\s"<>|]+"""),
    ("posix_path", r"(?U)(?<![\w.])(?:~?/[\w.-]+){2,}/?"),
    ("api_key", r"(?U)\b(?:sk|pk|rk|ghp|gho|xox[bap]|AKIA|ASIA)[-_A-Za-z0-9]{12,}\b"),
    ("bearer", r"(?Ui)\b(?:Bearer|Token)\s+[A-Za-z0-9._~+/=-]{16,}"),
    ("uuid", r"(?U)\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"),
    ("hash", r"(?U)\b[0-9a-fA-F]{32,128}\b"),
    ("base64", r"(?U)\b[A-Za-z0-9+/]{40,}={0,2}\b"),
    ("env_assign", r"(?U)\b[A-Z][A-Z0-9_]{2,}=[^\s;,]+"),
    ("quoted", r"""(?U)"[^"\n]{2,}"|'[^'\n]{2,}'"""),
    ("regex_lit", r"(?Ud)(?<!\w)/(?!/)[^/\\\n]*+(?:\\.[^/\\\n]*+)*+/[gimsuxy]*(?!\w)"),
    ("semver", r"(?U)\bv?\d+\.\d+\.\d+(?:[-+][\w.]+)?\b"),
    ("number_unit", r"(?Ui)\b\d[\d,]*(?:\.\d+)?\s?(?:%|ms|s|m|h|d|px|em|kb|mb|gb|tb|kib|mib|gib|hz|khz|mhz|ghz|usd|eur|gbp|\$|€|tokens?|bytes?)\b"),
    ("date", r"(?U)\b\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?(?:Z|[+-]\d{2}:?\d{2})?)?\b"),
    ("identifier", r"(?U)\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b"),
    ("camel_ident", r"(?U)\b[a-z]+(?:[A-Z][a-z0-9]*)+\b"),
    ("dotted_call", r"(?U)\b\w+(?:\.\w+)+\(?\)?"),
    ("filename", r"(?Ui)\b[\w-]+\.(?:py|js|ts|tsx|jsx|json|yaml|yml|toml|md|txt|csv|xml|html|css|sql|sh|ps1|bat|exe|dll|so|rs|go|java|c|cpp|h|hpp|ipynb|lock|env|cfg|ini)\b"),
)

#: What every match of a kind holds.
REGION_SIGNS = {
    "code_fence": "```", "json_block": "{", "xml_block": "</", "inline_code": "`", "url": "://", "email": "@", "win_path": ":", "unc_path": "\\\\", "posix_path": "/", "uuid": "-",
    "env_assign": "=", "regex_lit": "/", "semver": ".", "date": "-", "identifier": "_", "dotted_call": ".", "filename": ".",
}

#: What every match of a kind holds as well, found without a look at the borders of words.
REGION_SHAPES = {
    "win_path": r"[A-Za-z]:[\\/]", "hash": r"[0-9a-fA-F]{32}", "base64": r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}", "quoted": r"[\"']", "number_unit": r"(?U)\d", "date": r"(?U)\d-\d", "semver": r"(?U)\d\.\d",
    "api_key": r"[kpobaA][-_A-Za-z0-9]{12}", "bearer": r"[bBtT][eEoO][aAkKK][rReE]", "camel_ident": r"[a-z][A-Z]", "dotted_call": r"\.[^ \n]", "filename": r"\.[^ \n]",
}

#: What a match of a kind begins with.
REGION_STARTS = {"bearer": "bBtT", "hash": "0-9a-fA-F", "uuid": "0-9a-fA-F", "env_assign": "A-Z", "identifier": "a-z", "camel_ident": "a-z", "win_path": "A-Za-z", "api_key": "sprgxA", "number_unit": r"\p{Nd}", "date": r"\p{Nd}"}

# --- fixed values: phrases deleted, then rewritten, in order --------------------------------
DELETED = (
    r"\bplease\b,?\s*", r"\bkindly\s+", r"\bjust\s+(?=go|make|do|run|check|take|try|add|use)", r"\bgo ahead and\s+", r"\bfeel free to\s+",
    r"\bi(?:'d| would) like you to\s+", r"\bi want you to\s+", r"\bi need you to\s+", r"\bcould you(?: please)?\s+", r"\bcan you(?: please)?\s+",
    r"\bwould you(?: please)?\s+", r"\bi was wondering if you could\s+", r"\bhey,?\s+", r"\bas always,?\s+", r"\bremember(?: that)?,?\s+",
    r"\bnote that\s+", r"\bbasically,?\s+", r"\bessentially,?\s+", r"\bactually,?\s+",
)
REWRITTEN = (
    (r"\bin order to\b", "to"), (r"\bmake sure(?: that)?(?: you)?\b", "ensure"), (r"\bidentify any\b", "find"), (r"\bidentify\b", "find"),
    (r"\byou can find\b", ""), (r"\ball of them\b", "all"), (r"\beach of the\b", "each"), (r"\bthe following\b", "this"), (r"\bas follows\b", ":"),
    (r"\bwhether or not\b", "whether"), (r"\bat this point in time\b", "now"), (r"\bin the event that\b", "if"), (r"\bdue to the fact that\b", "because"),
    (r"\bwith respect to\b", "re"), (r"\bwith regard to\b", "re"), (r"\bin terms of\b", "re"), (r"\ba complete list of\b", "all"),
    (r"\bthe complete list of\b", "all"), (r"\bevery place where\b", "everywhere"), (r"\btogether with\b", "with"), (r"\balong with\b", "with"),
    (r"\bas well as\b", "and"), (r"\bis able to\b", "can"), (r"\bare able to\b", "can"), (r"\bit is necessary to\b", "must"), (r"\byou should\b", ""),
    (r"\byour task is to\b", ""), (r"\bwhat i want is\b", ""), (r"\bthe existing functionality\b", "existing behavior"), (r"\bfunctionality\b", "behavior"),
    (r"\bdocumentation\b", "docs"), (r"\brepository\b", "repo"), (r"\bapplication\b", "app"), (r"\bconfiguration\b", "config"),
    (r"\bimplementation\b", "impl"), (r"\benvironment\b", "env"), (r"\bdirectory\b", "dir"), (r"\bapproximately\b", "~"),
    (r"\bgreater than or equal to\b", ">="), (r"\bless than or equal to\b", "<="), (r"\bat least (\d+)\b", ">=$1"), (r"\bat most (\d+)\b", "<=$1"),
)
TIGHTENED = ((r"(?U)\s+([,;:.!?])", "$1"), (r"(?U)([,;:])\s*\1+", "$1"), (r"[ \t]{2,}", " "), (r"(?dm)^[ ,;]+|[ \t]+$", ""))

# --- fixed values: invariants ----------------------------------------------------------------
NEGATION = r"(?Ui)\b(?:not|no|never|don'?t|do not|won'?t|cannot|can'?t|shouldn'?t|mustn'?t|without|except|unless|only)\b"
NEGATION_START, MODALITY_START, COMPARATOR_START = "nNdDwWcCsSſmMeEuUoO", "mMsSſoOrRaA", "<>aAnNuUeE"
COMPARATOR_SHAPE = r"[<>tTnNoOyY](?:(?<=[<>])|(?U:\s*\d))"
PROHIBITIONS = ("not", "no", "never", "dont", "do not", "wont", "cannot", "cant", "shouldnt", "mustnt", "without")
NUMBER = r"(?U)\d+(?:\.\d+)?"
COMPARATOR = r"(?Ui)(<=|>=|<|>|(?:\bat least\b|\bat most\b|\bno more than\b|\bno fewer than\b|\bup to\b|\bexactly\b)(?=\s*\d))"
COMPARATOR_SIGNS = {"at least": ">=", "no fewer than": ">=", "at most": "<=", "no more than": "<=", "up to": "<=", "exactly": "=="}
MODALITY = r"(?Ui)\b(must(?: not)?|shall(?: not)?|should(?: not)?|may(?: not)?|optional(?:ly)?|required|mandatory|(?<!as )always)\b"
MODALITY_CLASSES = {"shall": "must", "shall not": "must not", "mandatory": "required", "optionally": "optional"}
FAILURE_COST = 0.4

# --- fixed values: dictionary ----------------------------------------------------------------
CODE = r"(?U)\b([KPE]\d+)\b"
CODE_START = "KPE"
CODE_SHAPE = r"[KPE](?U:\d)"
SEEDS = (
    ("K1", "analyze the program", (r"analy[sz]e th(?:is|e) (?:following )?(?:program|code)",)),
    ("K2", "preserve existing behavior", (
        r"(?:ensure )?(?:you )?preserve (?:the )?existing (?:functionality|behavior)", r"keep (?:the )?existing (?:functionality|behavior)(?: intact)?",
        r"maintain (?:the )?existing (?:functionality|behavior)")),
    ("K3", "do not break existing behavior", (
        r"do(?: |n['o]?t )not break (?:any )?existing (?:functionality|behavior)", r"do not break (?:any )?existing (?:functionality|behavior)",
        r"don'?t break (?:any )?existing (?:functionality|behavior)", r"without breaking (?:any )?existing (?:functionality|behavior)")),
    ("K4", "run the full test suite after changes", (r"run (?:the )?(?:full )?test(?:s| suite)(?: afterwards| after(?:wards)?| before finishing)?",)),
    ("K5", "preserve all public APIs exactly", (r"preserve all public APIs?(?: exactly(?: as they are)?)?", r"keep (?:all )?public APIs?(?: stable| unchanged)?")),
    ("K6", "update documentation to match changes", (r"update (?:the )?docs?(?:umentation)?(?: (?:to match|whenever behavior changes|accordingly))?",)),
    ("K7", "do not modify unrelated files", (
        r"(?:do not|don'?t|never) (?:modify|touch|change) (?:any )?(?:files? )?(?:that are )?unrelated(?: to (?:this|the current) task)?(?: files?)?",
        r"(?:do not|don'?t|never) modify (?:any )?unrelated (?:files?|code)")),
    ("K8", "return the complete implementation", (r"return (?:the |a )?complete impl(?:ementation)?", r"give (?:me )?(?:the |a )?(?:full|complete) impl(?:ementation)?")),
    ("K9", "explain each change made", (r"explain (?:each|all)(?: of)?(?: the)? changes(?: (?:you |that were )?made)?", r"explain (?:each|every) change(?: you made)?")),
    ("K10", "search project files", (r"search (?:the )?project(?: files)? for", r"search (?:all )?files in (?:the )?(?:project|repo) for")),
    ("K11", "list file paths with line numbers", (r"(?:return |list |give )?(?:all )?(?:the )?file paths (?:together )?with(?: the)? line numbers",)),
    ("K12", "fix all bugs found", (r"(?:find and )?fix (?:all|any)(?: of)?(?: the)? bugs(?: (?:you |that you )?(?:can )?f(?:i|ou)nd)?",)),
    ("K13", "add unit tests covering the change", (r"add (?:unit )?tests? (?:covering|for) (?:the|this|that) (?:change|fix|new behavior)",)),
    ("K14", "think step by step before answering", (r"think (?:carefully )?step[- ]by[- ]step(?: before (?:you )?answer(?:ing)?)?",)),
    ("K15", "cite sources for factual claims", (r"(?:cite|include|provide) (?:your )?sources(?: for (?:all )?factual claims)?",)),
)
BUNDLE, BUNDLE_MEMBERS, BUNDLE_LABEL = "P1", ("K3", "K4", "K5", "K6", "K7"), "standing project rules"
BUNDLE_GAP = r"[;,.]?\s*(?:and\s+)?"
BOOTSTRAP = "DICT v{version} (shorthand; expand mentally): "
CLAUSE_END = r"(?U)[;]|(?<=[.!?])\s+"
LEAST_CLAUSE, LEAST_PHRASE = 15, 12
CODE_COST, DEFINITION_COST, HORIZON, LEAST_NET, LEAST_COUNT, MINT_COST = 2, 6, 20, 20, 2, 40
MINT_EVERY = 25

# --- fixed values: sessions, folding, requests ------------------------------------------------
ENTITY = r"(?U)\b([A-Z][a-z0-9]+(?:\s+[A-Z][a-z0-9]+){1,3})\b"
ENTITY_SHAPE = r"[A-Z][a-z0-9]+(?U:\s)+[A-Z][a-z0-9]"
ENTITY_STOPS = ("The", "A", "An", "This", "That", "Our", "Your", "My", "Its", "In", "On", "At", "For", "With", "And", "Or", "But", "If")
FENCE = r"(?Us)```[^\n]*\n(.*?)```"
KEY_LINE = r"(?Ui)\b(error|fail(?:ed|ure)?|exception|traceback|decided?|decision|must|should not|do not|don't|constraint|requirement|warning|fixed|bug|todo|important|note:|conclusion|result)\b"
HEADER = r"(?U)^\s{0,3}#{1,6}\s|^\s*[-*]\s|^\s*\d+\.\s"
SENTENCE_GAP = r"(?U)(?<=[.!?])\s+"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
REFERENCE = r"(?U)\[(?:ref|code):([0-9a-f]{16})[^\]]*\]"
HISTORY = "HIST (compact digest of earlier turns; ask to expand any [code:...] ref): "
TERSE_STYLE_CODES = " You may use DICT/ENT codes in replies."
LEAST_REQUEST, LEAST_SAVED, LEAST_PERCENT, CACHE_DISCOUNT = 24, 6, 8.0, 0.9
LEAST_BLOB, LEAST_TOOL_RESULT, DIGEST_KEPT, LINE_LENGTH = 400, 200, 200, 240
DIGEST_WINDOW = {"MAX": 15}
DIGEST_WINDOW_OTHERWISE = 30

# --- fixed values: tokenizer profiles, the first that fits ---------------------------------------
PROFILES = (
    ("gpt-4o|gpt-5|o[134]|chatgpt", "o200k", "tiktoken", True), ("gpt-4|gpt-3\\.5|text-embedding", "cl100k", "tiktoken", True), ("claude|anthropic", "claude-est", "estimate", False),
    ("qwen", "qwen2.5", "hf", True), ("llama", "llama3", "hf", True), ("deepseek", "deepseek3", "hf", True), ("mistral|mixtral|ministral", "mistral", "hf", True), ("gemma", "gemma2", "hf", True),
)
PROFILE_OTHERWISE = ("o200k", "tiktoken", True)
CJK = r"[一-鿿぀-ヿ가-힯]"
TOKENS_PER_CJK, CHARS_PER_TOKEN = 1.1, 3.4
