"""Registries, fixed texts and the router configuration."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values. These must equal the evaluated program's values for results
# to agree, so they are stated here plainly and in their natural order.
# ---------------------------------------------------------------------------

# Multiple-choice answer prompt (header line, question line, options, tail).
MC_PROMPT_HEAD = (
    "Answer the following multiple-choice question with only the answer "
    "letter (A, B, C, or D):\nQuestion: "
)
MC_PROMPT_OPTIONS = "\nOptions:\n"
MC_PROMPT_TAIL = "Answer:"
# Placeholder options used when a row has no usable choices.
MC_PLACEHOLDER_CHOICES = ["Choice 1", "Choice 2", "Choice 3", "Choice 4"]

# Instruction prompt used before embedding a question.
INSTRUCT_HEAD = "Instruct: Given a multiple-choice question on "
INSTRUCT_MID = ", select the most correct answer from the choices.\nQuery: "
INSTRUCT_CHOICES = "\nChoices:\n"
INSTRUCT_LETTERS = ["A", "B", "C", "D"]

# First standalone capital A-D.
ANSWER_PATTERN = r"\b([A-D])\b"

# Short model name -> model id.
MODEL_REGISTRY = [
    ("gemma 2B", "google/gemma-2-2b-it"),
    ("llama 3B", "meta-llama/Llama-3.2-3B-Instruct"),
    ("qwen 7B", "Qwen/Qwen2.5-7B-Instruct-1M"),
    ("mistral 7B", "mistralai/Mistral-7B-Instruct-v0.3"),
    ("phi 2B", "microsoft/phi-2"),
    ("llama 8B", "meta-llama/Llama-3.1-8B-Instruct"),
    ("qwen 1.5B", "deepseek-ai/DeepSeek-R1-Distill-Qwen-1.5B"),
]

# The 57 task names, in order.
TASKS = [
    "abstract_algebra", "anatomy", "astronomy", "business_ethics", "clinical_knowledge",
    "college_biology", "college_chemistry", "college_computer_science", "college_mathematics",
    "college_medicine", "college_physics", "computer_security", "conceptual_physics",
    "econometrics", "electrical_engineering", "elementary_mathematics", "formal_logic",
    "global_facts", "high_school_biology", "high_school_chemistry", "high_school_computer_science",
    "high_school_european_history", "high_school_geography", "high_school_government_and_politics",
    "high_school_macroeconomics", "high_school_mathematics", "high_school_microeconomics",
    "high_school_physics", "high_school_psychology", "high_school_statistics",
    "high_school_us_history", "high_school_world_history", "human_aging", "human_sexuality",
    "international_law", "jurisprudence", "logical_fallacies", "machine_learning", "management",
    "marketing", "medical_genetics", "miscellaneous", "moral_disputes", "moral_scenarios",
    "nutrition", "philosophy", "prehistory", "professional_accounting", "professional_law",
    "professional_medicine", "professional_psychology", "public_relations", "security_studies",
    "sociology", "us_foreign_policy", "virology", "world_religions",
]

# Arms (routable models) in decision order, and their prices.
ARMS = ["gemma", "llama8B", "mistral", "qwen"]
ARM_PRICES = {"gemma": 0.1, "llama8B": 0.18, "mistral": 0.2, "qwen": 0.3}

# Command-line defaults of the router.
ROUTER_DEFAULTS = dict(alpha=0.0, lam=12.94, gamma=1.0, p=0.0)

# The two legal evaluation splits.
SPLITS = ["auxiliary_train", "test"]

# ---------------------------------------------------------------------------
# Unicode whitespace as Python's str.strip() sees it. Written as a regex
# class that both Java regex and RE2 accept, so Spark and the SQL oracle
# strip the same characters.
# ---------------------------------------------------------------------------
WS_CLASS = (
    r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


# Our own messages.
EMPTY_EVAL_ERROR = "no question was evaluated"
UNKNOWN_MODEL_ERROR = "{} is not in the model registry"
PART_SPLIT_ERROR = "only the split auxiliary_train is cut into parts"
ROUTE_SUMMARY_FORMAT = "mean accuracy {acc:.4f}, mean price per 10 000 questions {price:.2f}"


@dataclass(frozen=True)
class RouterConfig:
    """Parameters of the linear upper-confidence-bound router.

    alpha  exploration weight of the confidence term
    lam    ridge term: every arm starts from ``lam * I``
    gamma  discount applied to an arm's statistics before each update
    p      price sensitivity: reward = correct - p * price / max(price)
    """

    arms: tuple = tuple(ARMS)
    prices: tuple = tuple(ARM_PRICES[a] for a in ARMS)
    alpha: float = ROUTER_DEFAULTS["alpha"]
    lam: float = ROUTER_DEFAULTS["lam"]
    gamma: float = ROUTER_DEFAULTS["gamma"]
    p: float = ROUTER_DEFAULTS["p"]

    def __post_init__(self):
        if len(self.arms) != len(self.prices) or not self.arms:
            raise ValueError("arms and prices must be non-empty and of equal length")
        if not (0.0 < self.gamma <= 1.0):
            raise ValueError("gamma must lie in (0, 1]")
        if self.lam <= 0.0:
            raise ValueError("lam must be positive")

    @property
    def k(self) -> int:
        return len(self.arms)

    @property
    def normalised_prices(self) -> tuple:
        top = max(self.prices)
        return tuple(p / top for p in self.prices)
