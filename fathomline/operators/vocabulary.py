"""Patterns and phrases of the two built-in subjects: artificial intelligence, and digital ties between companies.

Everything in this module is a fixed value: it decides results. Patterns are for Java, without regard to case.
"""

from __future__ import annotations

# Fixed values --------------------------------------------------------------------------------------------

#: Signals of artificial intelligence that stand for themselves.
AI_HARD = (
    r"\b(?:"
    r"artificial intelligence|machine learning|deep learning|"
    r"neural network|natural language processing|"
    r"generative AI|GenAI|large language model|LLM|foundation model|"
    r"ChatGPT|GPT-[34]|GPT-4o|Copilot|Gemini|Claude AI|"
    r"computer vision|image recognition|"
    r"robotic process automation|RPA|"
    r"MLOps|SageMaker|Vertex AI|Azure ML|Watsonx|"
    r"reinforcement learning|transfer learning|"
    r"transformer model|BERT|XGBoost|random forest|"
    r"prompt engineering|fine[\s-]?tuning|RLHF|RAG|"
    r"autonomous vehicle|self[\s-]?driving|agentic AI|AI agent|"
    r"responsible AI|ethical AI|AI governance|"
    r"AI[\s-](?:powered|driven|enabled|first)|AI\s+(?:system|platform|model|solution)"
    r")\b"
)
#: Signals of artificial intelligence that meaning must confirm.
AI_SOFT = (
    r"\b(?:"
    r"intelligent|algorithm|automation|embedding|"
    r"model|prediction|analytics|robot(?:ic)?s?|"
    r"cognitive|smart|digital transform|"
    r"data[\s-]driven|data science|"
    r"transformer|multimodal|"
    r"NLP|ML\b|DL\b|"
    r"Claude|Gemini|Llama|Mistral"
    r")\b"
)
#: Signals of digital ties that stand for themselves, English and Chinese.
DIGITAL_HARD = (
    r"(?:"
    r"partner onboarding portal|supplier onboarding portal|vendor registration portal|"
    r"partner portal|supplier portal|dealer portal|distributor portal|"
    r"electronic data interchange|\bEDI\b|API integration|API gateway|iPaaS|middleware|"
    r"control tower|shared data space|data sovereignty|sovereign data exchange|"
    r"GAIA-X|Catena-X|digital product passport|battery passport|product carbon footprint|"
    r"blockchain traceability|chain of custody|provenance tracking|"
    r"industrial IoT|\bIIoT\b|digital twin|connected asset|remote monitoring|"
    r"federated identity|identity federation|zero trust|secure data exchange|"
    r"API marketplace|ecosystem orchestration|complementor|multi-sided platform|"
    r"digital servitization|outcome-based contract|cross-company data sharing|interoperability framework|"
    r"数字化|数字化转型|伙伴门户|合作伙伴门户|供应商门户|经销商门户|分销商门户|"
    r"电子数据交换|数据共享|数据空间|共享数据空间|数据主权|主权数据交换|"
    r"互操作|互联互通|控制塔|数字产品护照|电池护照|产品碳足迹|"
    r"区块链追溯|全程追溯|来源追踪|工业物联网|数字孪生|远程监控|"
    r"联邦身份|身份联邦|零信任|安全数据交换|API市场|生态系统编排|补充者|"
    r"平台治理|数字服务化|跨企业数据共享|互操作框架"
    r")"
)
#: Signals of digital ties that meaning must confirm, English and Chinese.
DIGITAL_SOFT = (
    r"(?:"
    r"platform|portal|ecosystem|partner|supplier|dealer|distributor|channel|"
    r"workflow|automation|integration|interoperability|shared|exchange|connect|connected|"
    r"cloud platform|data platform|data exchange|traceability|compliance platform|"
    r"visibility|transparency|governance|knowledge sharing|co-innovation|servitization|"
    r"marketplace|dashboard|network|interface|"
    r"平台|门户|生态|合作伙伴|供应商|经销商|分销商|渠道|"
    r"工作流|自动化|集成|整合|互操作|共享|交换|连接|协同|"
    r"云平台|数据平台|数据交换|追溯|合规平台|可视化|透明度|治理|知识共享|"
    r"共同创新|服务化|市场平台|仪表板|网络|接口"
    r")"
)
#: Roots of the codes that belong to digital ties.
DIGITAL_ROOTS = ("D", "T", "G")
#: Phrases whose meaning a reference to artificial intelligence is near to.
AI_ANCHORS = (
    "artificial intelligence implementation in business",
    "machine learning model deployed for operations",
    "deep learning neural network training",
    "AI-powered product or service feature",
    "natural language processing text analysis",
    "generative AI large language model GPT",
    "computer vision image recognition system",
    "robotic process automation intelligent automation",
    "AI governance ethics responsible AI policy",
    "AI talent workforce upskilling data scientist",
    "predictive analytics forecasting machine learning",
    "AI investment strategy transformation initiative",
    "AI risk compliance fraud detection cybersecurity",
    "foundation model fine-tuning RLHF prompt engineering",
    "AI infrastructure MLOps platform deployment",
    "autonomous vehicle agentic AI multi-agent system",
)
#: Talk of rules and safety: negative words in it are no negative sentiment.
GOVERNANCE = (
    r"(?i)\b(?:"
    r"responsible AI|ethical AI|AI ethics|AI governance|AI policy|"
    r"bias (?:detection|mitigation)|algorithmic fairness|"
    r"AI safety|guardrails|hallucination|alignment|red teaming|"
    r"explainab(?:le|ility)|interpretab(?:le|ility)|"
    r"trustworthy AI|transparent AI|accountable AI|"
    r"risk framework|compliance framework"
    r")\b"
)
#: Signs of plans, for the forward-looking factor.
FORWARD_LOOKING = (
    r"(?i)\b(?:"
    r"will|plan(?:ned|ning)?|intend|expect|target|forecast|roadmap|"
    r"next year|future|upcoming|by \d{4}|going forward|"
    r"initiative|pilot|proof of concept|POC|prototype"
    r")\b"
)
#: Signs of weight, for the salience factor.
SALIENCE = (
    r"(?i)\b(?:"
    r"invest(?:ed|ing|ment)|acqui(?:red|ring|sition)|partner(?:ed|ship)|"
    r"launch(?:ed|ing)?|deploy(?:ed|ing|ment)|implement(?:ed|ing|ation)|"
    r"billion|million|\$[\d,.]+|center of excellence|AI team|"
    r"dedicated|committed|strategic"
    r")\b"
)
#: Names of an earlier list of categories and their codes.
FORMER_CATEGORIES = {
    "Product Development": "A1_Product_Innovation",
    "Research & Innovation": "A1_Product_Innovation",
    "Operational Implementation": "A2_Operational_Excellence",
    "Customer Experience": "A3_Customer_Experience",
    "Risk & Compliance": "A4_Risk_Compliance",
    "Data & Analytics": "A5_Data_Analytics",
    "Strategic Investment": "A6_Strategy_Investment",
    "Explainability & AI Safety": "A7_Governance_Ethics",
    "Talent & Workforce": "A8_Talent_Workforce",
    "Generative AI & LLMs": "B4_GenAI_LLMs",
    "AI Infrastructure & MLOps": "B7_Infrastructure_Platforms",
    "AI Coding & Development": "B7_Infrastructure_Platforms",
    "Agentic AI Systems": "B6_Robotics_Autonomous",
}
#: Terms that a reference found by meaning is marked at, the first that occurs.
PRIORITY_TERMS = (
    r"\bgenerative AI\b", r"\bGenAI\b", r"\blarge language model(?:s)?\b",
    r"\bLLM(?:s)?\b", r"\bartificial intelligence\b", r"\bmachine learning\b",
    r"\bdeep learning\b", r"\bneural network(?:s)?\b", r"\bGPT\b",
    r"\bChatGPT\b", r"\bCopilot\b", r"\bpredictive analytics\b",
    r"\bnatural language processing\b", r"\bcomputer vision\b",
    r"\bautonomous\b", r"\brobot(?:ic)?(?:s)?\b", r"\bRPA\b",
    r"\bRAG\b", r"\bembedding(?:s)?\b", r"\bvector\s+database\b",
    r"\b(?:AI|ML)\b(?![\w-])", r"\bchatbot\b", r"\bautomation\b",
    r"\bpartner onboarding portal\b", r"\bsupplier portal\b", r"\bpartner portal\b",
    r"\bcontrol tower\b", r"\bshared data space\b", r"\bdata sovereignty\b",
    r"\bsovereign data exchange\b", r"\bGAIA-X\b", r"\bCatena-X\b",
    r"\bdigital product passport\b", r"\bbattery passport\b",
    r"\bblockchain traceability\b", r"\bindustrial IoT\b", r"\bdigital twin\b",
    r"\bfederated identity\b", r"\bzero trust\b", r"\bAPI marketplace\b",
    r"\becosystem orchestration\b", r"\bdigital servitization\b",
    r"数字化转型", r"数字化", r"合作伙伴门户", r"供应商门户", r"控制塔",
    r"数据共享", r"数据空间", r"数据主权", r"主权数据交换", r"互操作",
    r"数字产品护照", r"电池护照", r"区块链追溯", r"工业物联网", r"数字孪生",
    r"联邦身份", r"零信任", r"生态系统编排", r"平台治理", r"知识共享",
)
