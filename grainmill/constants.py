"""Fixed values the results depend on."""

# Reserved markers, ids 0..4 in this order.
SPECIAL_TOKENS = ["<|pad|>", "<|problem|>", "<|step|>", "<|answer|>", "<|end|>"]
PAD_ID = 0
END_ID = 4

PROBLEM = "<|problem|>"
STEP = "<|step|>"
ANSWER = "<|answer|>"
END = "<|end|>"

# Prompts put in front of plain text by the base recipe.
STORY_PROMPT = "Continue the story:"
WEB_PROMPT = "Reason through this:"

# Mixture weights in declaration order. The cpt list spells one source differently
# from its registry and names one the registry lacks; both are skipped, not redistributed.
BASE_WEIGHTS = [
    ("tinystories", 0.20),
    ("metamathqa", 0.40),
    ("gsm8k", 0.05),
    ("arc", 0.05),
    ("openwebmath", 0.30),
]
CPT_WEIGHTS = [
    ("tinystories", 0.25),
    ("wikipedia", 0.30),
    ("bookscorpus", 0.25),
    ("metamathqa", 0.10),
    ("gsm8k", 0.05),
    ("arc", 0.05),
]

# Sizes.
WINDOW = 1024
VOCAB_SIZE = 8004
MIN_FREQUENCY = 2
BATCH_SIZE = 8
GRAD_ACCUM = 16
EPOCHS = 3
LOG_EVERY = 100
CHECKPOINT_EVERY = 500
VOTE_SAMPLES = 8
TOP_K = 50
TEMPERATURE = 0.8

# Tokenizer corpus, rows taken per source (None = all), in this order.
TOKENIZER_CORPUS = [
    ("metamathqa", 50_001),
    ("tinystories", 20_001),
    ("gsm8k", 7_001),
    ("arc", None),
]

# The 29 code points Python's str.strip() removes.
WHITESPACE = "".join(
    chr(c)
    for c in [
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
        *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    ]
)

# Fixed value: the byte-level pre-token pattern.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
