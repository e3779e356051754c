"""Word lists and rules of query planning, as tables.

A rule is (needs, terms): needs is a tuple of groups, and a text meets the rule when it holds a word of every group.
"""

from __future__ import annotations

# Method names looked for in queries.
METHODS = (
    "artificial intelligence", "machine learning", "deep learning", "deep neural network", "neural network", "knowledge distillation", "llm", "large language model",
    "language model compression", "vision-language", "multimodal", "moe", "dpo", "rlhf", "rl", "bm25", "tf-idf", "transformer", "diffusion", "generative adversarial network",
    "convolutional neural network", "lora", "low-rank adaptation", "contrastive learning", "prompt tuning", "instruction tuning", "in-context learning", "chain-of-thought",
    "few-shot", "zero-shot", "self-supervised", "semi-supervised", "active learning", "curriculum learning", "meta-learning", "federated learning", "pruning", "quantization",
    "neural architecture search", "graph neural network", "attention mechanism", "cross-attention", "self-attention", "reinforcement learning from human feedback",
    "direct preference optimization", "retrieval augmented generation", "rag",
)
# Task words.
TASKS = (
    "compress", "compression", "generation", "retrieval", "ranking", "translation", "translating", "planning", "reasoning", "summarization", "evaluation", "benchmark", "alignment",
    "quantization", "quantized", "pretraining", "pre-training", "captioning", "description", "extraction", "watermarking", "detection", "classification", "recognition", "diagnosis",
    "diagnostics", "treatment", "therapy", "screening", "prediction", "training efficiency",
)
# Names of subjects looked for in queries.
ENTITIES = (
    "in-context learning", "large language model agent", "language model agent", "pre-trained language model", "tunisian arabic dialect", "reward shaping", "video description",
    "long video description", "event extraction", "document-level event extraction", "vocabulary watermarking", "hallucination", "factual consistency", "abstractive summarization",
    "quantized pretraining", "scholarly documents", "text generation", "code generation", "image generation", "sentiment analysis", "named entity recognition", "relation extraction",
    "legal text analysis", "legal natural language processing", "legal nlp", "machine translation", "question answering", "reading comprehension", "text classification",
    "semantic segmentation", "object detection", "face recognition", "facial recognition", "masked face recognition", "occluded face recognition", "partial face recognition",
    "face recognition under occlusion", "real-time face recognition", "efficient face recognition", "lightweight face recognition", "medical imaging", "medical imaging diagnostics",
    "tumor detection", "cancer imaging", "lung cancer", "non-small cell lung cancer", "computer vision", "efficient inference", "model acceleration", "autonomous driving",
    "autonomous vehicle", "autonomous vehicles", "autonomous vehicle decision making", "robotic decision making", "driving decision making", "spam detection", "speech recognition",
    "speech data augmentation", "text-to-speech", "image captioning", "visual question answering", "dialogue system", "chatbot", "few-shot learning",
    "data-efficient natural language processing", "semi-supervised natural language processing", "self-supervised natural language processing", "network traffic analysis",
    "traffic classification", "intrusion detection", "real-time traffic classification", "time series classification", "multilingual language models", "cross-lingual transfer",
    "language barrier", "reinforcement learning", "long-term reward optimization", "sequential decision making", "cerebrospinal fluid", "cerebrospinal fluid biomarkers", "amyloid beta",
    "beta-amyloid", "tau protein", "Alzheimer's disease", "vaccine development", "mRNA vaccines", "emerging infectious diseases", "personalized immunotherapy", "cancer immunotherapy",
    "precision oncology", "precision medicine", "immune checkpoint blockade", "embedding", "representation learning", "feature extraction", "alignment", "safety", "jailbreak",
    "red-teaming", "long context", "context window", "token limit", "parameter-efficient", "adapter", "prefix tuning",
)
# Chinese patterns and what they stand for, by kind.
CHINESE = {
    "methods": ((r"检索增强生成|检索增强|RAG", "retrieval augmented generation"), (r"大语言模型|大模型", "large language model"), (r"引用网络|引文网络|citation", "citation network"), (r"重排序|重排|rerank", "reranking")),
    "tasks": ((r"检索|搜索", "retrieval"), (r"重排序|重排|排序", "ranking"), (r"缓解|检测|识别", "detection")),
    "entities": ((r"幻觉", "hallucination"), (r"学术搜索|论文检索", "scholarly search"), (r"论文推荐", "paper recommendation"), (r"引用网络|引文网络", "citation network"), (r"重排序|重排", "reranking")),
}
# Openings that carry no topic, as planning and as search text leave them out.
PREFIXES = (
    "give me papers which show that", "give me papers that", "give me papers about", "provide me with all papers that", "provide me with papers that", "provide me with all papers",
    "provide me with papers", "provide me with", "provide papers on", "provide papers about", "find papers that", "find papers about", "find papers on", "papers that", "papers which propose",
    "list all papers that", "do you know some papers about", "show me research on", "i am looking for research papers on", "i am looking for papers on",
    "i am looking to understand more about", "i am looking to understand",
)
SEARCH_PREFIXES = (
    "i am looking to understand more about", "i am looking to understand", "give me papers which show that", "give me papers that", "give me papers about", "provide me with all papers that",
    "provide me with papers that", "provide me with all papers", "provide me with papers", "provide me with", "find papers about", "find papers on", "find papers that", "papers that",
    "list all papers that", "do you know some papers about", "papers which propose", "papers that demonstrate", "work on", "study about", "show me research on", "show me papers on",
    "provide papers on", "provide papers about", "provide papers explaining why", "i am looking for research papers on", "i am looking for papers on", "can you help me find research papers that",
)
# Phrases of broad requests.
BROAD = (
    "all papers", "papers that discuss", "papers about", "papers explaining", "papers that show", "list research", "show me research", "papers that share", "provide me with all",
    "could you list research", "papers on",
)
# Words left out of a focused query.
FOCUS_STOPWORDS = (
    "a", "about", "all", "am", "and", "application", "applications", "apply", "are", "as", "at", "be", "defined", "discuss", "do", "does", "for", "here", "how", "i", "in", "is", "it", "its",
    "looking", "me", "methods", "model", "models", "more", "of", "on", "or", "paper", "papers", "process", "research", "share", "show", "significant", "some", "such", "suggest", "that", "the",
    "those", "to", "train", "training", "understand", "use", "using", "with", "you", "which", "could", "recommend", "study", "studies", "investigate", "investigates", "investigating",
    "explore", "explores", "explored", "like", "first", "would", "work", "works", "refer", "learning",
)
# Words that may stand in lower case within a title.
TITLE_STOPWORDS = ("a", "an", "and", "are", "for", "in", "is", "of", "on", "or", "the", "to", "with")

# Conditions that several tables share.
_LEGAL = (("legal",), ("language model", "large-scale language", "llm"))
_FACES = (("face recognition", "facial recognition"), ("mask", "masked", "occlusion", "occluded"))
_FAST_FACES = (*_FACES, ("real-time", "real time", "processing time", "efficient"))
_SPEECH = (("speech recognition",), ("gan", "generative adversarial"))
_FEW = (("few-shot", "few shot", "unlabeled"), ("nlp", "natural language"))
_DRIVING = (("autonomous",), ("driving", "vehicle", "decision"))
_TRAFFIC = (("network traffic", "real-time traffic"),)
_TONGUES = (("multilingual", "language barrier"),)
_REWARD = (("reinforcement learning",), ("long-term", "long term", "reward"))
_VISION = ("computer vision", "deep learning", "deep neural network")
_FAST = (("efficient inference", "model acceleration", "processing time"), _VISION)
_ALZHEIMER = (("cerebrospinal fluid", "amyloid", "tau protein"), ("alzheimer",))
_VACCINE = (("vaccine",), ("infectious", "development"))
_IMMUNE = (("immunotherapy",), ("cancer",))
_RAG = (("retrieval augmented generation",), ("hallucination",))
_DENOISING = (("sequence-to-sequence",), ("denoising",), ("pre-training", "pretraining"))
_DISTILLED = (("knowledge distillation",), ("compress", "compression", "language model"))
_TUNISIAN = (("tunisian arabic dialect",), ("translat",))
_GENERATED = (("hallucination",), ("sequence generation", "generation"))

# Entities that a query's words imply.
DERIVED_ENTITIES = (
    ((("sentiment analysis",), ("context", "accuracy")), ("context-aware sentiment analysis", "aspect-level sentiment classification")),
    ((("spam detection",),), ("spam detection",)),
    ((("knowledge distillation",), ("compress", "compression")), ("language model compression",)),
    ((("knowledge distillation",), ("compress", "compression"), ("language model",)), ("pre-trained language model",)),
    ((("knowledge distillation",), ("compress", "compression"), ("task-agnostic", "task agnostic")), ("task-agnostic knowledge distillation",)),
    (_LEGAL, ("legal large language models", "legal natural language processing", "automated legal text analysis")),
    (_FACES, ("masked face recognition", "occluded face recognition", "partial face recognition", "face recognition under occlusion")),
    ((*_FACES, ("real-time", "real time", "processing time", "speed")), ("real-time face recognition", "efficient face recognition", "lightweight face recognition")),
    ((("lung cancer",),), ("non-small cell lung cancer",)),
    ((("lung cancer",), ("treatment", "therapy")), ("targeted lung cancer therapy", "immune checkpoint inhibitors")),
    ((("medical imaging",), ("tumor", "cancer", "diagnos")), ("medical imaging diagnostics", "tumor detection", "cancer imaging")),
    ((("autonomous", "driving"), ("decision", "vehicle", "robot")), ("autonomous driving", "autonomous vehicle decision making", "driving decision making")),
    (_SPEECH, ("speech recognition", "speech data augmentation")),
    (_FEW, ("few-shot learning", "data-efficient natural language processing", "semi-supervised natural language processing")),
    ((("network traffic",),), ("network traffic analysis", "traffic classification", "intrusion detection")),
    ((("real-time",), ("traffic",)), ("network traffic analysis", "traffic classification", "intrusion detection")),
    (_TONGUES, ("multilingual language models", "cross-lingual transfer", "machine translation")),
    (_REWARD, ("long-term reward optimization", "sequential decision making")),
    ((("inference", "processing time", "speed"), _VISION), ("efficient inference", "model acceleration", "computer vision")),
    ((("cerebrospinal fluid", "amyloid", "β-amyloid", "aβ"), ("alzheimer", "tau")), ("cerebrospinal fluid biomarkers", "amyloid beta", "tau protein", "Alzheimer's disease")),
    (_VACCINE, ("vaccine development", "mRNA vaccines", "emerging infectious diseases")),
    (_IMMUNE, ("personalized immunotherapy", "cancer immunotherapy", "precision oncology", "immune checkpoint blockade")),
    (_TUNISIAN, ("tunisian arabic dialect translation",)),
    ((*_TUNISIAN, ("resource", "data")), ("parallel resources",)),
    ((*_TUNISIAN, ("translated comment", "native speaker")), ("translated comments",)),
    ((*_GENERATED, ("token", "sentence", "summarization")), ("factual consistency", "abstractive summarization")),
)
# Synonyms of a query's domain, in order.
SYNONYMS = (
    ((("sentiment analysis",),), ("context-aware sentiment analysis", "aspect-level sentiment classification")),
    (_LEGAL, ("legal large language models", "legal natural language processing", "legal text mining")),
    (_FACES, ("masked face recognition", "occluded face recognition", "partial face recognition", "face recognition under occlusion")),
    (_FAST_FACES, ("real-time face recognition", "efficient face recognition", "lightweight face recognition")),
    ((("lung cancer",),), ("non-small cell lung cancer", "immune checkpoint inhibitors", "targeted lung cancer therapy")),
    (_DRIVING, ("autonomous driving", "autonomous vehicle decision making", "motion planning")),
    (_SPEECH, ("speech data augmentation", "adversarial speech recognition")),
    (_FEW, ("few-shot learning", "data-efficient NLP", "semi-supervised NLP")),
    (_TRAFFIC, ("network traffic analysis", "traffic classification", "intrusion detection")),
    (_TONGUES, ("multilingual language models", "cross-lingual transfer", "machine translation")),
    (_REWARD, ("long-term reward optimization", "sequential decision making")),
    (_FAST, ("efficient deep learning inference", "model acceleration", "real-time computer vision")),
    (_ALZHEIMER, ("cerebrospinal fluid biomarkers", "amyloid beta tau", "Alzheimer disease progression")),
    (_VACCINE, ("vaccine development", "mRNA vaccines", "emerging infectious diseases")),
    (_IMMUNE, ("personalized cancer immunotherapy", "precision oncology", "immune checkpoint blockade")),
    (_RAG, ("retrieval augmented generation hallucination", "faithful scholarly search")),
    (_DENOISING, ("denoising sequence-to-sequence pre-training",)),
    (_DISTILLED, ("language model compression", "knowledge distillation")),
    ((("smaller dataset", "fewer data", "less data"), ("pretraining", "pre-training")), ("data efficient pretraining", "data pruning", "training data selection")),
    ((("tunisian arabic dialect",), ("translat", "parallel")), ("Tunisian Arabic dialect translation", "parallel resources")),
    (_GENERATED, ("factual consistency", "abstractive summarization")),
    ((("in-context learning",),), ("emergent in-context learning", "implicit in-context learning")),
    ((("reward shaping",),), ("dense reward", "reinforcement learning feedback")),
    ((("vocabulary watermarking", "watermarking"),), ("llm watermarking", "text generation watermark")),
    ((("quantized",), ("pretraining",)), ("quantization pretraining", "low precision training")),
    ((("survey",), ("scholarly", "literature")), ("automatic survey generation", "literature review generation")),
    ((("alignment", "safety"),), ("model alignment", "ai safety", "harmlessness alignment")),
    ((("jailbreak", "adversarial"),), ("adversarial attack", "jailbreak attack", "red teaming")),
    ((("long context", "context window"),), ("long context window", "extended context", "context length")),
    ((("parameter-efficient", "peft"),), ("parameter efficient fine-tuning", "peft", "adapter module")),
    ((("lora", "low-rank"),), ("low-rank adaptation", "lora fine-tuning", "weight decomposition")),
    ((("chain-of-thought", "cot"),), ("cot prompting", "reasoning prompting", "thought chain")),
    ((("benchmark", "evaluat", "bench"),), ("benchmark evaluation", "evaluation metric", "performance benchmark")),
)
# The core terms of a query's domain, in order.
CORE_TERMS = (
    ((("sentiment analysis",),), ("sentiment analysis", "contextual sentiment analysis")),
    (_LEGAL, ("large language models", "legal text analysis")),
    (_FACES, ("masked face recognition", "occluded face recognition", "face recognition under occlusion")),
    (_FAST_FACES, ("real-time face recognition", "efficient face recognition")),
    ((("lung cancer",),), ("lung cancer treatment", "non-small cell lung cancer")),
    (_DRIVING, ("autonomous driving", "autonomous vehicle decision making")),
    (_SPEECH, ("speech recognition", "speech data augmentation")),
    (_FEW, ("few-shot learning", "semi-supervised natural language processing")),
    (_TRAFFIC, ("network traffic analysis", "traffic classification")),
    (_TONGUES, ("multilingual language models", "cross-lingual transfer")),
    (_REWARD, ("reinforcement learning", "long-term reward optimization")),
    (_FAST, ("computer vision", "efficient inference")),
    (_ALZHEIMER, ("cerebrospinal fluid biomarkers", "Alzheimer disease progression")),
    (_VACCINE, ("vaccine development", "emerging infectious diseases")),
    (_IMMUNE, ("cancer immunotherapy", "precision oncology")),
    (_RAG, ("retrieval augmented generation", "hallucination")),
    ((*_RAG, ("scholarly search",)), ("scholarly search",)),
    (_DENOISING, ("denoising sequence-to-sequence pre-training",)),
    (_DISTILLED, ("knowledge distillation", "language model compression")),
    (_TUNISIAN, ("Tunisian Arabic dialect translation",)),
    (_GENERATED, ("conditional neural sequence generation hallucinated content",)),
)
# The method terms of a query's domain, in order.
METHOD_TERMS = (
    ((("sentiment analysis",),), ("aspect-level sentiment classification", "sentiment classification")),
    (_LEGAL, ("legal NLP", "automated legal text analysis")),
    (_FACES, ("deep face recognition", "masked face recognition", "lightweight face recognition")),
    ((("lung cancer",),), ("immune checkpoint inhibitors", "targeted therapy lung cancer")),
    (_DRIVING, ("motion planning", "decision making autonomous vehicles")),
    (_SPEECH, ("generative adversarial network speech", "speech data augmentation")),
    (_FEW, ("few-shot text classification", "semi-supervised NLP")),
    (_TRAFFIC, ("traffic classification", "intrusion detection")),
    (_TONGUES, ("cross-lingual transfer", "machine translation")),
    (_REWARD, ("reward optimization", "sequential decision making")),
    (_FAST, ("model acceleration", "real-time computer vision")),
    (_ALZHEIMER, ("amyloid beta tau biomarkers", "cerebrospinal fluid biomarker")),
    (_VACCINE, ("mRNA vaccines", "rapid vaccine development")),
    (_IMMUNE, ("personalized immunotherapy", "immune checkpoint blockade")),
    (_RAG, ("retrieval augmented generation hallucination",)),
    ((*_RAG, ("citation network",)), ("citation network",)),
    ((*_RAG, ("reranking",)), ("reranking",)),
    (_DENOISING, ("denoising sequence-to-sequence pre-training natural language",)),
    ((("tunisian arabic dialect",), ("segment",)), ("Tunisian Arabic dialect translation", "segmentation stop words")),
    ((("knowledge distillation",), ("task-agnostic", "task agnostic")), ("task-agnostic knowledge distillation",)),
    ((("hallucination",), ("token", "sentence", "summarization")), ("factual consistency abstractive summarization",)),
)
# Searches that a biomedical topic adds.
BIOMEDICAL = (
    ((("lung cancer",),), (
        "molecular testing non-small cell lung cancer management", "PD-1 blockade resectable lung cancer", "RNA therapies non-small cell lung cancer clinical trials",
        "microRNA mimics lipid emulsion lung tumors", "targeted therapies advanced non-small cell lung cancer", "lung cancer molecular diagnosis treatment review",
    )),
)
# Clues, all of which a query holds, to the title of a well-known paper; the first that fits counts.
KNOWN_TITLES = (
    (("denoising", "sequence-to-sequence", "pre-training"), "BART: Denoising Sequence-to-Sequence Pre-training for Natural Language Generation, Translation, and Comprehension"),
    (("transformer", "self-attention", "rnn"), "Attention Is All You Need"),
    (("bert", "bidirectional", "unlabeled text"), "BERT: Pre-training of Deep Bidirectional Transformers for Language Understanding"),
    (("bert", "bidirectional transformers", "language understanding"), "BERT: Pre-training of Deep Bidirectional Transformers for Language Understanding"),
    (("gpt-3", "few-shot"), "Language Models are Few-Shot Learners"),
    (("webtext", "unsupervised multitask"), "Language Models are Unsupervised Multitask Learners"),
    (("llama", "7b", "65b"), "LLaMA: Open and Efficient Foundation Language Models"),
    (("residual learning", "deeper"), "Deep Residual Learning for Image Recognition"),
    (("imagenet", "hierarchical image database"), "ImageNet: A large-scale hierarchical image database"),
    (("alexnet", "lsvrc-2012"), "ImageNet Classification with Deep Convolutional Neural Networks"),
    (("vgg", "network depth"), "Very Deep Convolutional Networks for Large-Scale Image Recognition"),
    (("you only look once", "object detection"), "You Only Look Once: Unified, Real-Time Object Detection"),
    (("yolo", "object detection"), "You Only Look Once: Unified, Real-Time Object Detection"),
    (("single shot multibox", "detector"), "SSD: Single Shot MultiBox Detector"),
    (("ssd", "single deep neural network"), "SSD: Single Shot MultiBox Detector"),
    (("faster r-cnn", "region proposal network"), "Faster R-CNN: Towards Real-Time Object Detection with Region Proposal Networks"),
    (("mask r-cnn", "object mask"), "Mask R-CNN"),
    (("u-net", "biomedical image segmentation"), "U-Net: Convolutional Networks for Biomedical Image Segmentation"),
    (("vision transformer", "image patches"), "An Image is Worth 16x16 Words: Transformers for Image Recognition at Scale"),
    (("vit", "image patches"), "An Image is Worth 16x16 Words: Transformers for Image Recognition at Scale"),
    (("clip", "natural language supervision"), "Learning Transferable Visual Models From Natural Language Supervision"),
    (("nerf", "neural radiance fields"), "NeRF: Representing Scenes as Neural Radiance Fields for View Synthesis"),
    (("generative adversarial", "discriminative"), "Generative Adversarial Nets"),
    (("variational autoencoder", "variational bayes"), "Auto-Encoding Variational Bayes"),
    (("vae", "variational bayes"), "Auto-Encoding Variational Bayes"),
    (("denoising diffusion probabilistic", "diffusion models"), "Denoising Diffusion Probabilistic Models"),
    (("ddpm", "diffusion models"), "Denoising Diffusion Probabilistic Models"),
    (("alphago", "game of go"), "Mastering the game of Go with deep neural networks and tree search"),
    (("atari", "deep q-networks"), "Human-level control through deep reinforcement learning"),
    (("proximal policy optimization", "policy gradient"), "Proximal Policy Optimization Algorithms"),
    (("ppo", "policy gradient"), "Proximal Policy Optimization Algorithms"),
    (("adam", "first", "second moments"), "Adam: A Method for Stochastic Optimization"),
    (("dropout", "overfitting"), "Dropout: A Simple Way to Prevent Neural Networks from Overfitting"),
    (("batch normalization", "internal covariate shift"), "Batch Normalization: Accelerating Deep Network Training by Reducing Internal Covariate Shift"),
    (("long short-term memory", "vanishing gradient"), "Long Short-Term Memory"),
    (("word2vec", "skip-gram"), "Efficient Estimation of Word Representations in Vector Space"),
    (("glove", "global co-occurrence"), "GloVe: Global Vectors for Word Representation"),
    (("low-rank adaptation", "fine-tuning"), "LoRA: Low-Rank Adaptation of Large Language Models"),
    (("lora", "rank decomposition"), "LoRA: Low-Rank Adaptation of Large Language Models"),
)
