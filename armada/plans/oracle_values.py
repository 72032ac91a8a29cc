"""Fixed values of the SQL oracle, stated again on purpose: the oracle shares
no constant with the modules that it checks."""

from types import SimpleNamespace

#: Prompt texts.
MC_PROMPT_HEAD = ("Answer the following multiple-choice question with only the answer letter (A, B, C, or D):\n"
                  "Question: ")
MC_PROMPT_OPTIONS = "\nOptions:\n"
MC_PROMPT_TAIL = "Answer:"
INSTRUCT_HEAD = "Instruct: Given a multiple-choice question on "
INSTRUCT_MID = ", select the most correct answer from the choices.\nQuery: "
INSTRUCT_CHOICES = "\nChoices:\n"
EMPTY_EVAL_ERROR = "no question was evaluated"

#: Model names and ids, the tasks in order (one line of words), white space of Python's strip.
MODEL_REGISTRY = [
    ("gemma 2B", "google/gemma-2-2b-it"),
    ("llama 3B", "meta-llama/Llama-3.2-3B-Instruct"),
    ("qwen 7B", "Qwen/Qwen2.5-7B-Instruct-1M"),
    ("mistral 7B", "mistralai/Mistral-7B-Instruct-v0.3"),
    ("phi 2B", "microsoft/phi-2"),
    ("llama 8B", "meta-llama/Llama-3.1-8B-Instruct"),
    ("qwen 1.5B", "deepseek-ai/DeepSeek-R1-Distill-Qwen-1.5B"),
]
TASKS = """
abstract_algebra anatomy astronomy business_ethics clinical_knowledge college_biology college_chemistry
college_computer_science college_mathematics college_medicine college_physics computer_security conceptual_physics
econometrics electrical_engineering elementary_mathematics formal_logic global_facts high_school_biology
high_school_chemistry high_school_computer_science high_school_european_history high_school_geography
high_school_government_and_politics high_school_macroeconomics high_school_mathematics high_school_microeconomics
high_school_physics high_school_psychology high_school_statistics high_school_us_history high_school_world_history
human_aging human_sexuality international_law jurisprudence logical_fallacies machine_learning management marketing
medical_genetics miscellaneous moral_disputes moral_scenarios nutrition philosophy prehistory professional_accounting
professional_law professional_medicine professional_psychology public_relations security_studies sociology
us_foreign_policy virology world_religions
""".split()
WS_CLASS = (r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
EVAL_MODELS = ["gemma 2B", "llama 3B", "mistral 7B"]
RUN_MODELS = ["gemma 2B", "llama 3B", "mistral 7B", "phi 2B"]
MODEL_REQUESTS = ["llama 3B,gemma 2B", "qwen 7B,mistral 7B", "phi 2B,llama 8B,qwen 1.5B", "gemma 2B"]

#: The parameters of the registered queries.
ROUTE_CFG = SimpleNamespace(arms=("gemma", "llama8B", "mistral", "qwen"), prices=(0.1, 0.18, 0.2, 0.3), k=4, alpha=0.5,
                            lam=12.94, p=0.3, normalised_prices=tuple(v / 0.3 for v in (0.1, 0.18, 0.2, 0.3)))
LEARN_CFG = SimpleNamespace(alpha=0.5, lam=2.0, gamma=0.9)
BATCH_CFG = SimpleNamespace(gamma=0.999)
KEYED_D, BATCH_D, WIDE_D = 4, 132, 512
REPEAT_ROWS = 250
DISC_GAMMA, DISC_LAM = 0.99, 1.0
HASH_DIM = 32
SAMPLE_FRACTION, SAMPLE_SEED = 0.25, 42
SPLIT_SEED, TRAIN_SIZE = 1010, 0.75
ORDER_SEED = 0
REPEATS = 3
