"""Parameters shared by the registered queries and their DuckDB oracle."""

BUDGET = 300_000            # C2/C3 cut that lands inside the larger sources at sf0.01
NO_BUDGET = (1 << 63) - 1
SOURCE_BUDGETS = {"en": 250_000, "de": 90_000}   # C2 with a budget per source
PROGRESS_STEP = 100_000     # C4 marks (the reference prints every 5M)
CAP_DOCS = 100              # A3 per-source doc cap
BLEND_DOCS = 50             # B1 docs per source
TOK_DOCS = 50_000           # docs per source for tokenizer training (reference default)
VOCAB = 8000                # learned vocabulary for the merged-tokenizer queries (reference default)
BYTE_VOCAB = 261            # specials + bytes, no merges
SEQ_LEN = 128
BATCH = 8
N_BATCHES = 250             # 2,000 windows
SEED = 1337
MIX = {"en": 0.5, "de": 0.2, "es": 0.2, "fr": 0.2, "xx": 0.5}
VAL_BATCH = 4               # val loader batch in the reference's check script
VAL_BATCHES = 50            # batches a val loader averages over (reference default)
EVAL_ROUNDS = 2
# Run presets (fixed values): name, seq_len, batch_size, grad_accum, max_steps.
PRESETS = (("smoke", 128, 4, 2, 20), ("local30m", 512, 8, 8, 6000), ("small60m", 1024, 16, 8, 4000))
QUOTAS = {"mcq": 6000, "qa": 4000, "instr": 2000}   # E4 first-n per source (reference defaults)
SFT_MAX_LEN = 512
SFT_EPOCHS = 3
SFT_BATCH = 16
SFT_SEED = 0
EVAL_LIMIT = 500            # questions per task (reference default)
EVAL_MAX_LEN = 512          # context window of the scored model
TRUNC_MAX_LEN = 8           # a window shorter than most options, to exercise F5
LAMBDA = 0.9                # bigram weight of the count scorer
TOPK = 5
TEMPERATURE = 0.7
TOKENS_PER_STEP = 8 * 8 * 512   # local30m preset: batch x accum x seq_len
# local30m learning-rate schedule (fixed values): lr, min_lr, warmup_steps, max_steps
LR_SCHEDULE = (8.0e-4, 8.0e-5, 200, 6000)
LR_FAULT_EVERY = 97             # G6 fixture: every 97th logged row carries a wrong lr
SFT_LR = 1.0e-4             # instruction-tuning peak learning rate (reference default)
