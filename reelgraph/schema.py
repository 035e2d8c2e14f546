"""Data model: node and edge tables, vocabularies, and the records that model inference delivers."""

from __future__ import annotations

#: One row per node; ``ord`` is the order of insertion inside a video, times are seconds from its start.
NODES = (
    "video_id string, node_id string, ord bigint, node_type string, label string, level int, t_start double, t_end double, keyframe_id string, "
    "bbox array<double>, confidence double, entity_id string, canonical_description string, prev_state string, next_state string, parent_id string, "
    "temporal_precision double, meta_extra map<string,string>"
)
#: One row per edge; ``disc`` tells parallel edges of a type apart (the time of an emotion shift).
EDGES = (
    "video_id string, src string, dst string, relation_type string, family string, eord bigint, weight double, confidence double, disc double, "
    "reasoning string, source string, meta_extra map<string,string>"
)
SCENE_WINDOWS = "video_id string, win_id string, parent_scene_id string, window_idx int, t_start double, t_end double, raw_json string"
SCENE_JSON = (
    "reasoning string, scene_label string, location string, "
    "objects array<struct<label:string,bbox_norm:array<double>,confidence:double,attributes:array<string>,state:string>>, "
    "actions array<struct<description:string,actor:string,object:string,confidence:double,approx_timestamp:double>>, "
    "spatial_relations array<struct<subject:string,relation:string,object:string>>, "
    "characters array<struct<description:string,bbox_norm:array<double>,emotion:string,action:string>>, "
    "ocr_text array<struct<text:string,bbox_norm:array<double>,confidence:double>>, "
    "state_changes array<struct<entity:string,from_state:string,to_state:string,approx_timestamp:double>>, "
    "scene_mood string, current_speaker string, speaker_on_screen boolean, narrative_function string, "
    "ocr_semantics array<struct<text:string,semantic_type:string,refers_to:string>>, "
    "mentioned_entities array<struct<text:string,refers_to_label:string>>"
)
CAUSAL_LINK = "cause string, effect string, relation string, confidence double, reasoning string"
ENTITY = "canonical_id string, canonical_name string, canonical_description string, description_variants array<string>, entity_type string"
EPISODE = "label string, start_scene_idx int, end_scene_idx int, narrative_role string, summary string"
ACTION = "action string, relation string, node_id string, option string, query string, letter string, cited_node_ids array<string>"
PLAN = "windows array<struct<t_start:double,t_end:double>>, search_queries array<string>, needs_frames boolean, reasoning string"
VIDEO_TYPE = "video_type string, reasoning string"

# The vocabularies of the data model.
NODE_LEVELS = {
    "VideoNode": 3, "EpisodeNode": 2, "SceneNode": 1, "LocationNode": 1, "ClipNode": 0, "ObjectNode": 0, "CharacterNode": 0, "ActionNode": 0,
    "StateChangeNode": 0, "OCRNode": 0, "SpeechNode": 0, "AudioEventNode": 0,
}
CAUSAL = ("CAUSES", "ENABLES", "PREVENTS", "MOTIVATES")
FAMILIES = {
    "causal": CAUSAL, "entity": ("SAME_ENTITY",), "speaker": ("SPOKEN_BY",), "temporal": ("PRECEDES", "OVERLAPS", "DURING"), "emotion": ("EMOTION_SHIFT",),
    "similar": ("SIMILAR_TO", "DESCRIBES"), "contains": ("CONTAINS",),
}
SPATIAL = ("LEFT_OF", "RIGHT_OF", "ABOVE", "BELOW", "IN_FRONT_OF", "BEHIND", "INSIDE", "ON_TOP_OF", "NEAR")
EPISODE_EVENTS = ("ActionNode", "InteractionNode", "StateChangeNode", "SpeechNode", "OCRNode", "AudioEventNode")
ONLINE_EVENTS = ("ActionNode", "InteractionNode", "StateChangeNode", "SpeechNode", "SceneNode", "AudioEventNode")
DECLARED_NOT_EMITTED = ("DURING", "INSTANCE_OF", "INTERACTS_WITH", "LOCATED_IN", "CONTRADICTS")
EMITTED_NOT_DECLARED = ("CO_OCCURS_WITH",)

KEYWORD_INTENTS = (
    ("who ", "IDENTITY"), ("whose ", "IDENTITY"), ("where ", "SPATIAL"), ("what if ", "COUNTERFACT"), ("had not ", "COUNTERFACT"), ("summarize", "SUMMARY"), ("overview", "SUMMARY"),
)
QUESTION_INTENTS = {
    "key information retrieval": ("SEMANTIC", "TEMPORAL"), "entity recognition": ("IDENTITY", "SEMANTIC"), "event understanding": ("CAUSAL", "TEMPORAL", "STATE"),
    "reasoning": ("CAUSAL", "INTENTIONAL"), "temporal grounding": ("TEMPORAL",), "summarization": ("SUMMARY",), "subtitle-based retrieval": ("SEMANTIC", "TEMPORAL"),
    "visual-related reasoning": ("CAUSAL", "SPATIAL", "SEMANTIC"), "temporal understanding": ("TEMPORAL", "STATE"), "action recognition": ("SEMANTIC", "STATE"),
    "character understanding": ("IDENTITY", "EMOTIONAL", "INTENTIONAL"), "causal reasoning": ("CAUSAL",), "counterfactual reasoning": ("COUNTERFACT", "CAUSAL"),
    "emotional reasoning": ("EMOTIONAL",), "intentional reasoning": ("INTENTIONAL",), "prospective reasoning": ("PROSPECTIVE",), "spatial understanding": ("SPATIAL",),
    "multi-step reasoning": ("CAUSAL", "TEMPORAL", "INTENTIONAL"), "common sense reasoning": ("CAUSAL", "SEMANTIC"), "video understanding": ("SUMMARY", "SEMANTIC"),
    "scene understanding": ("SEMANTIC", "SPATIAL"), "object recognition": ("SEMANTIC", "IDENTITY"),
}
SLOT_TYPES = {
    "causal": ("reasoning", "causal reasoning", "event understanding", "intentional reasoning", "multi-step reasoning", "common sense reasoning", "counterfactual reasoning"),
    "temporal": ("temporal grounding", "temporal understanding", "action recognition"),
    "entity": ("entity recognition", "key information retrieval", "subtitle-based retrieval", "character understanding", "object recognition"),
    "summary": ("summarization", "video understanding"),
}
SLOTS = {"causal": "causal_edge", "temporal": "temporal_occurrences", "entity": "entity_or_frame", "summary": "episode_summary"}
#: Gap slot: seconds around the anchor, frames.
BUILD_WINDOWS = {"causal_edge": (30.0, 8), "entity_or_frame": (10.0, 12), "temporal_occurrences": (60.0, 6), "mcq_option_coverage": (15.0, 8), "episode_summary": (90.0, 6)}
BUILD_DEFAULT, BUILD_MOST_FRAMES = (30.0, 8), 32

# Seconds, budgets and thresholds.
WINDOW_BUFFER, DETAIL_BUFFER, ZOOM_BUFFER, FOCUS, LONG_SPAN, MENTION_GAP, BANNER_GAP, CLUSTER_GAP = 30.0, 5.0, 5.0, 30.0, 300.0, 120.0, 5.0, 120.0
NODE_BUDGET, WALK_BUDGET, CONTEXT_ROWS, HOPS, FRONTIER_K = 60, 80, 40, 4, 5
SEED_SIMILARITY, SEARCH_SIMILARITY, INTENT_SIMILARITY, EDGE_SIMILARITY = 0.3, 0.25, 0.25, 0.78
EVENT_JACCARD, SPEAKER_JACCARD, MERGE_JACCARD, CAUSAL_CONFIDENCE = 0.24, 0.25, 0.40, 0.6
HARD_CUT, SOFT_CUT, SOFT_HIST = 0.75, 0.5, 0.3
NO_CLIP = 999.0

#: What a speech recogniser delivers; a video without sound has no rows.
ASR_SEGMENTS = "video_id string, ord bigint, start double, end double, text string, avg_logprob double"
#: What a decoder delivers of the times that ``sources.readers.coarse_grid`` asks for; images' long side is at most ``LONG_SIDE``.
FRAMES = "video_id string, frame_id string, ord bigint, ts double, jpeg binary, hist array<double>, motion double, text_score double"
LONG_SIDE = 1024
#: Characters of a context that a prompt holds at most.
CONTEXT_CHARS = 140_000
