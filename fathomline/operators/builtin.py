"""Two taxonomies that are there from the start: ``ai`` and ``digital``.

The names of the codes are fixed values; keywords and patterns are this library's own, and few: callers with lists of
their own pass a taxonomy from sheets, or extend these (Taxonomy.merged).
"""

from __future__ import annotations

from fathomline.operators import vocabulary
from fathomline.operators.taxonomy import COOCCUR, COOCCUR_VERB, NONE, SOFT, Code, Taxonomy, Weights, register


def _codes(gate: str, rows: dict[str, tuple[str, str]], tiers: tuple[int, int] = (1, 2)) -> tuple[Code, ...]:
    """Codes from (keywords, patterns), both parted by semicolons; the first two keywords are the strongest."""
    out = []
    for name, (words, patterns) in rows.items():
        keywords = tuple((w.strip(), tiers[0] if i < 2 else tiers[1]) for i, w in enumerate(words.split(";")))
        out.append(Code(name, name.split("_", 1)[1].replace("_", " "), keywords, tuple(rf"\b(?:{p.strip()})\b" for p in patterns.split(";")), gate))
    return tuple(out)


APPLICATIONS = {
    "A1_Product_Innovation": ("product innovation;new product;research and development;prototype", r"(?:ai|ml)[\s-]powered (?:product|feature|service)s?;drug discovery"),
    "A2_Operational_Excellence": ("predictive maintenance;process automation;supply chain;efficiency;quality control", r"(?:optimi[sz]\w+|automat\w+) (?:of )?(?:operations|production|logistics)"),
    "A3_Customer_Experience": ("chatbot;personalization;customer service;virtual assistant;recommendation", r"(?:customer|shopper|guest) (?:experience|support|service)"),
    "A4_Risk_Compliance": ("fraud detection;cybersecurity;compliance;risk management;anomaly detection", r"(?:fraud|risk|threat) (?:detection|scoring|model\w*)"),
    "A5_Data_Analytics": ("predictive analytics;forecasting;data science;business intelligence;insight", r"(?:advanced|predictive|real[\s-]time) analytics"),
    "A6_Strategy_Investment": ("ai strategy;ai investment;partnership;acquisition;transformation", r"(?:invest\w*|acqui\w+|partner\w*) (?:in|with|of) [\w\s]{0,30}(?:ai|artificial intelligence)"),
    "A7_Governance_Ethics": ("responsible ai;ai governance;ethics;bias;transparency", r"(?:responsible|ethical|trustworthy) ai;ai (?:policy|principles|act)"),
    "A8_Talent_Workforce": ("data scientist;upskilling;training;workforce;talent", r"(?:ai|data) (?:skills|literacy|talent|academy)"),
}
TECHNOLOGIES = {
    "B1_Traditional_ML": ("machine learning;random forest;regression;clustering;algorithm", r"machine[\s-]learning;gradient boosting"),
    "B2_Deep_Learning": ("deep learning;neural network;reinforcement learning;transfer learning", r"(?:deep|convolutional|recurrent) (?:learning|neural networks?)"),
    "B3_NLP_NonLLM": ("natural language processing;text mining;sentiment analysis;speech recognition", r"natural language (?:processing|understanding);nlp"),
    "B4_GenAI_LLMs": ("generative ai;large language model;chatgpt;copilot;foundation model", r"generative ai;gen\s?ai;llms?;gpt(?:-\d\w*)?"),
    "B5_Computer_Vision": ("computer vision;image recognition;object detection;facial recognition", r"(?:computer|machine) vision;image (?:recognition|analysis)"),
    "B6_Robotics_Autonomous": ("autonomous vehicle;robotic process automation;robot;drone;agentic ai", r"(?:autonomous|self[\s-]driving) \w+;rpa;ai agents?"),
    "B7_Infrastructure_Platforms": ("mlops;ai platform;data lake;gpu;cloud", r"(?:ai|ml) (?:platform|infrastructure|pipeline)s?;mlops"),
    "B8_General_AI": ("artificial intelligence;intelligent system;cognitive;ai", r"artificial intelligence"),
}
AI = Taxonomy(
    "ai",
    (("A", _codes(NONE, APPLICATIONS)), ("B", _codes(NONE, TECHNOLOGIES))),
    false_positives=(
        ("embedding_in_culture", (r"embedd?(?:ed|ing) (?:sustainability|esg|safety|values|culture|risk)",)),
        ("financial_model", (r"(?:valuation|pricing|business|operating|financial|black[\s-]scholes) models?\b", r"model (?:year|portfolio|contract)")),
        ("physical_product", (r"smart(?:phone|watch| meter| card)", r"transformer (?:station|oil|winding)")),
        ("generic_automation", (r"\bautomation\b",)),
    ),
    catch_all=(r"\bautomation\b",),
    subject_context=r"artificial intelligence|machine learning|\bai\b|\bml\b|neural|deep learning|generative",
    anchors=vocabulary.AI_ANCHORS,
    weights=Weights(0.5, (0.4, 0.25, 0.1)),
)

TIES = {
    "D1_Partner_Onboarding_Access": ("partner portal;supplier portal;onboarding;registration", r"(?:partner|supplier|vendor|dealer) (?:onboarding|portal|registration)"),
    "D2_Transactional_Integration": ("electronic data interchange;e-invoicing;e-procurement;order integration", r"edi;electronic data interchange;e-?(?:procurement|invoicing)"),
    "D3_Collaborative_Planning_Visibility": ("control tower;collaborative planning;supply chain visibility;joint forecasting", r"control towers?;(?:collaborative|joint) (?:planning|forecasting)"),
    "D4_Shared_Data_Interoperability": ("data space;data sharing;data exchange;interoperability", r"(?:shared )?data spaces?;cross-company data sharing"),
    "D5_Channel_Partner_Interface": ("dealer platform;distributor portal;channel partner;marketplace", r"(?:dealer|distributor|channel) (?:platform|portal|interface)s?"),
    "D6_CoInnovation_Digital_Servitization": ("co-innovation;servitization;outcome-based contract;as a service", r"(?:digital )?servitization;outcome-based contracts?"),
    "D7_Ecosystem_Orchestration_Complementors": ("ecosystem orchestration;complementor;multi-sided platform;developer ecosystem", r"ecosystem (?:orchestration|platform);complementors?"),
    "D8_Traceability_Compliance_Network": ("digital product passport;traceability;battery passport;carbon footprint", r"(?:digital product|battery) passports?;chain of custody"),
}
TOOLS = {
    "T1_ERP_SCM_Backbone": ("erp;supply chain management system;s/4hana", r"erp systems?;scm (?:system|suite)s?"),
    "T2_API_EDI_iPaaS_Middleware": ("api gateway;ipaas;middleware;api integration", r"api (?:gateway|integration|marketplace)s?;ipaas"),
    "T4_Cloud_Data_Platforms": ("cloud platform;data platform;data lake", r"(?:cloud|data) platforms?"),
    "T5_IoT_Digital_Twins_Connected_Assets": ("digital twin;industrial iot;connected asset;remote monitoring", r"digital twins?;iiot;connected (?:asset|machine)s?"),
    "T6_Identity_Access_Security": ("federated identity;zero trust;access management", r"zero trust;federated identit(?:y|ies)"),
    "T7_Blockchain_DLT_Traceability": ("blockchain;distributed ledger", r"blockchain;distributed ledgers?"),
    "T8_Workflow_Automation_LowCode": ("workflow automation;low-code", r"low[\s-]code;workflow automation"),
}
GOALS = {
    "G1_Transparency_Visibility_Control": ("transparency;visibility", r"(?:end-to-end|real-time) (?:visibility|transparency)"),
    "G2_Trust_Security_Assurance": ("trust;secure data exchange;assurance", r"secure data exchange;trusted (?:network|partner)s?"),
    "G3_Data_Sovereignty_Ownership_Rights": ("data sovereignty;data ownership", r"(?:data|digital) sovereignty"),
    "G4_Standards_Interoperability_Rules": ("interoperability framework;open standard", r"interoperability (?:framework|standard)s?"),
    "G5_Orchestration_Roles_Incentives": ("platform governance;incentive", r"platform governance"),
    "G6_Joint_Learning_Knowledge_Sharing": ("knowledge sharing;joint learning", r"knowledge sharing;joint learning"),
}
DIGITAL = Taxonomy(
    "digital",
    (("D", _codes(COOCCUR, TIES)), ("T", _codes(COOCCUR_VERB, TOOLS)), ("G", _codes(SOFT, GOALS))),
    false_positives=(
        ("oil_platform", (r"(?:oil|drilling|offshore|train|railway) platforms?",)),
        ("television_channel", (r"(?:tv|television|distribution) channels?",)),
        ("person_network", (r"(?:alumni|women'?s|employee) networks?",)),
    ),
    actors=("partner", "supplier", "customer", "dealer", "distributor", "vendor", "合作伙伴", "供应商", "客户"),
    verbs=("connect", "integrat", "exchang", "collaborat", "shar", "coordinat", "连接", "共享", "协同"),
    markers=("digital", "platform", "data", "cloud", "online", "software", "数字", "平台", "数据"),
    weights=Weights(0.7, (0.8, 0.6, 0.4)),
)

for _t in (AI, DIGITAL):
    register(_t)
