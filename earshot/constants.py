"""Fixed values. They decide results, so they are listed once, plainly."""

# --- fixed values: audio and framing -------------------------------------
SAMPLE_RATE = 16000
FRAME_SAMPLES = 1280
SECONDS_PER_FRAME = 0.08
WINDOW_FRAMES = 16
FEATURE_WIDTH = 96
SEGMENT_SECONDS = 10
MIN_SEGMENT_SECONDS = 3
SILENCE_RMS = 1e-4

# --- fixed values: roles, conditions, stress grid ------------------------
SOURCE_ROLES = ["speech", "music", "env"]
BACKGROUND_ROLES = ["speech", "babble", "music", "env"]
CONDITIONS = ["clean", "env", "music", "speech", "babble"]
STRESS_SNRS = [20, 15, 10, 5, 0]
STRESS_CELLS = ["babble@15", "babble@10", "music@10"]
STRESS_RESERVE = 6
AUDIO_SUFFIXES = ["wav", "flac", "mp3", "ogg"]

# --- fixed values: evaluation --------------------------------------------
THRESHOLDS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]
COMPARE_AT = 0.5
FA_BUDGETS = [0.2, 0.5, 1.0, 2.0]
GROUPING_SECONDS = 4.0
RECALL_NOISE = 0.03
RECALL_REAL = 0.05
PARITY_TOLERANCE = 1e-4
METER_DECAY = 0.7

# --- fixed values: batches and augmentation ------------------------------
BATCH_ROWS = {"negative": 1024, "positive": 50, "adversarial": 50}
AUGMENT_BATCH = 16
AUGMENT_PROBABILITY = {
    "eq": 0.25,
    "tanh": 0.25,
    "pitch": 0.25,
    "band_stop": 0.25,
    "noise": 0.25,
    "background": 0.75,
    "gain": 1.0,
    "rir": 0.5,
}
BACKGROUND_SNR_DB = (-10.0, 15.0)
