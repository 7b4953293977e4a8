"""Fixed values.

These tables must equal the upstream catalog's published data for results to
match: the category taxonomy, the security frameworks, and the default keyword
rules used for tagging. They are kept here as plain data, in their natural
order, and are turned into small broadcastable DataFrames by
``quire.sources.dims``. Operators never read these constants directly: rules,
taxonomy and frameworks are always passed in as DataFrames so that a user can
supply their own.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: taxonomy (8 domains, 46 categories), in published order.
# (domain_id, domain_label, [(category_id, category_label), ...])
# ---------------------------------------------------------------------------
TAXONOMY = [
    ("attacks-threats", "Attacks & Threats", [
        ("prompt-injection", "Prompt Injection"),
        ("jailbreaking", "Jailbreaking"),
        ("data-poisoning", "Data Poisoning"),
        ("model-extraction", "Model Extraction"),
        ("membership-inference", "Membership Inference"),
        ("adversarial-examples", "Adversarial Examples"),
        ("supply-chain-attacks", "Supply Chain Attacks"),
        ("social-engineering", "Social Engineering"),
        ("agentic-threats", "Agentic Threats"),
    ]),
    ("defenses-mitigations", "Defenses & Mitigations", [
        ("input-filtering", "Input Filtering"),
        ("output-moderation", "Output Moderation"),
        ("guardrails", "Guardrails"),
        ("access-control", "Access Control"),
        ("monitoring-detection", "Monitoring & Detection"),
        ("sandboxing-isolation", "Sandboxing & Isolation"),
        ("cryptographic-controls", "Cryptographic Controls"),
        ("watermarking", "Watermarking"),
    ]),
    ("privacy", "Privacy", [
        ("differential-privacy", "Differential Privacy"),
        ("federated-learning", "Federated Learning"),
        ("data-anonymization", "Data Anonymization"),
        ("unlearning", "Machine Unlearning"),
        ("confidential-computing", "Confidential Computing"),
    ]),
    ("governance-compliance", "Governance & Compliance", [
        ("risk-frameworks", "Risk Frameworks"),
        ("model-governance", "Model Governance"),
        ("audit-assurance", "Audit & Assurance"),
        ("responsible-ai", "Responsible AI"),
        ("incident-response", "Incident Response"),
    ]),
    ("red-teaming-evaluation", "Red Teaming & Evaluation", [
        ("red-teaming", "Red Teaming"),
        ("benchmarks", "Benchmarks & Evaluation"),
        ("fuzzing", "Fuzzing"),
        ("vulnerability-disclosure", "Vulnerability Disclosure"),
    ]),
    ("infrastructure-deployment", "Infrastructure & Deployment", [
        ("model-serving-security", "Model Serving Security"),
        ("rag-security", "RAG Security"),
        ("fine-tuning-security", "Fine-Tuning Security"),
        ("mlops-security", "MLOps Security"),
        ("cloud-ai-security", "Cloud AI Security"),
    ]),
    ("agentic-ai-security", "Agentic AI Security", [
        ("agent-architecture", "Agent Architecture"),
        ("tool-use-security", "Tool Use Security"),
        ("memory-security", "Memory Security"),
        ("human-in-the-loop", "Human-in-the-Loop"),
        ("autonomous-operations", "Autonomous Operations"),
    ]),
    ("surveys-meta", "Surveys & Meta", [
        ("survey", "Surveys"),
        ("threat-modeling", "Threat Modeling"),
        ("industry-report", "Industry Reports"),
        ("book", "Books"),
        ("conference-proceedings", "Conference Proceedings"),
    ]),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: frameworks (5 frameworks, 55 controls), in published order.
# (framework_id, name, version, url, [control_id, ...])
# ---------------------------------------------------------------------------
FRAMEWORKS = [
    ("owasp_llm_top10", "OWASP Top 10 for LLM Applications", "2025",
     "https://owasp.org/www-project-top-10-for-large-language-model-applications/",
     ["LLM01", "LLM02", "LLM03", "LLM04", "LLM05", "LLM06", "LLM07", "LLM08", "LLM09", "LLM10"]),
    ("owasp_agentic_top10", "OWASP Top 10 for Agentic AI", "2025",
     "https://owasp.org/www-project-top-10-for-large-language-model-applications/",
     ["AGT01", "AGT02", "AGT03", "AGT04", "AGT05", "AGT06", "AGT07", "AGT08", "AGT09", "AGT10"]),
    ("mitre_atlas", "MITRE ATLAS", "4.0", "https://atlas.mitre.org/",
     ["AML.T0000", "AML.T0001", "AML.T0010", "AML.T0015", "AML.T0018", "AML.T0020",
      "AML.T0024", "AML.T0025", "AML.T0034", "AML.T0035", "AML.T0040", "AML.T0042",
      "AML.T0043", "AML.T0044", "AML.T0047", "AML.T0048", "AML.T0049", "AML.T0050",
      "AML.T0051", "AML.T0054", "AML.T0056", "AML.T0057"]),
    ("nist_ai_rmf", "NIST AI Risk Management Framework", "1.0",
     "https://www.nist.gov/artificial-intelligence/executive-order-safe-secure-and-trustworthy-artificial-intelligence",
     ["GOVERN", "MAP", "MEASURE", "MANAGE"]),
    ("iso_42001", "ISO/IEC 42001", "2023", "https://www.iso.org/standard/81230.html",
     ["4", "5", "6", "7", "8", "9", "10", "A", "B"]),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: default keyword rules (43 categories, 133 keywords), in rule
# order. A category is tagged when any of its keywords is a plain substring of
# the lower-cased "title abstract" text.
# ---------------------------------------------------------------------------
DEFAULT_RULES = [
    ("prompt-injection", ["prompt injection", "indirect injection"]),
    ("jailbreaking", ["jailbreak", "jailbreaking", "safety bypass"]),
    ("data-poisoning", ["data poisoning", "training data poison", "backdoor attack"]),
    ("model-extraction", ["model extraction", "model stealing", "model theft"]),
    ("membership-inference", ["membership inference", "training data extraction", "data leakage"]),
    ("adversarial-examples", ["adversarial example", "adversarial attack", "adversarial perturbation", "evasion attack"]),
    ("supply-chain-attacks", ["supply chain", "model repository", "dependency attack"]),
    ("social-engineering", ["deepfake", "ai-generated phishing", "voice cloning", "synthetic media"]),
    ("agentic-threats", ["agent attack", "agentic", "tool misuse", "agent security"]),
    ("input-filtering", ["input filter", "input validation", "prompt filter"]),
    ("output-moderation", ["output filter", "content filter", "output moderation"]),
    ("guardrails", ["guardrail", "safety training", "constitutional ai", "alignment"]),
    ("access-control", ["access control", "authorization", "rbac", "abac"]),
    ("monitoring-detection", ["anomaly detection", "monitoring", "drift detection"]),
    ("sandboxing-isolation", ["sandbox", "sandboxing", "execution containment", "tool sandbox"]),
    ("cryptographic-controls", ["homomorphic encryption", "secure multi-party computation", "model signing"]),
    ("watermarking", ["watermark"]),
    ("differential-privacy", ["differential privacy", "dp-sgd"]),
    ("federated-learning", ["federated learning", "federated fine-tuning"]),
    ("data-anonymization", ["data anonymization", "pii removal", "de-identification", "synthetic data generation"]),
    ("unlearning", ["machine unlearning", "model unlearning"]),
    ("confidential-computing", ["confidential computing", "trusted execution environment", "secure enclave", "tee inference"]),
    ("risk-frameworks", ["nist ai rmf", "iso 42001", "eu ai act", "ai risk management framework"]),
    ("model-governance", ["model card", "model governance", "model lifecycle", "datasheet for datasets"]),
    ("audit-assurance", ["ai audit", "ai assurance", "algorithmic audit"]),
    ("responsible-ai", ["responsible ai", "trustworthy ai", "ai ethics"]),
    ("incident-response", ["ai incident", "ai forensics", "ai security playbook"]),
    ("red-teaming", ["red team", "red-team"]),
    ("benchmarks", ["benchmark", "evaluation framework"]),
    ("fuzzing", ["llm fuzzing", "prompt fuzzing", "fuzz testing"]),
    ("vulnerability-disclosure", ["vulnerability disclosure", "coordinated disclosure", "cve assignment"]),
    ("model-serving-security", ["model serving security", "inference endpoint security", "inference api security"]),
    ("rag-security", ["rag security", "retrieval augmented", "vector database attack"]),
    ("fine-tuning-security", ["fine-tuning security", "fine-tuning attack", "lora attack"]),
    ("mlops-security", ["mlops security", "ml pipeline security", "model artifact security"]),
    ("cloud-ai-security", ["managed ai service", "multi-tenant ai", "cloud ai security"]),
    ("agent-architecture", ["multi-agent", "agent architecture"]),
    ("tool-use-security", ["tool use", "function calling", "plugin security"]),
    ("memory-security", ["memory poisoning", "long-term memory attack", "context window attack"]),
    ("human-in-the-loop", ["human-in-the-loop", "human oversight", "human approval"]),
    ("autonomous-operations", ["autonomous agent", "self-modifying agent", "agent containment"]),
    ("survey", ["survey of", "survey on", "systematic review", "systematization of knowledge", "literature review"]),
    ("threat-modeling", ["threat model", "threat modeling", "attack taxonomy", "kill chain"]),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: catalog entry schema vocabularies and bounds.
# ---------------------------------------------------------------------------
ENTRY_TYPES = ["paper", "book", "report", "tool", "standard", "talk", "blog", "dataset"]
SOURCE_APIS = ["semantic-scholar", "arxiv", "crossref", "manual"]
ENTRY_REQUIRED = ["id", "type", "title", "authors", "year", "url", "categories",
                  "added_date", "reviewed"]
SCHEMA_YEAR_MIN = 2017
SCHEMA_YEAR_MAX = 2030
FRAMEWORK_KEYS = ["owasp_llm_top10", "owasp_agentic_top10", "mitre_atlas", "nist_ai_rmf", "iso_42001"]
EXTERNAL_ID_KEYS = ["arxiv_id", "semantic_scholar_id", "doi"]

# ---------------------------------------------------------------------------
# FIXED VALUES: search field weights and cut-off; thresholds.
# ---------------------------------------------------------------------------
SEARCH_WEIGHTS = [("title", 0.4), ("abstract", 0.2), ("authors", 0.15),
                  ("categories", 0.1), ("tags", 0.1), ("venue", 0.05)]
SEARCH_THRESHOLD = 0.35
SEARCH_MIN_MATCH_CHARS = 2
DEDUP_THRESHOLD = "0.85"      # strict: similarity must be greater
BACKFILL_THRESHOLD = "0.85"   # inclusive: similarity may be equal
CANDIDATE_YEAR_MIN = 2017
ABSTRACT_MAX_CHARS = 500
SOURCE_ORDER = ["arxiv", "semantic-scholar", "crossref"]
