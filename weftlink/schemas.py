"""Record types and the numbers that matching and geometry go by."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


PLAYERS = struct(PlayerId=I, TeamId=I, FamilyName=S, SurName=S, External_Player_ID=S, ValidMapping=B, Confidence=D)
TEAMS = struct(TeamId=I, TeamName=S)
RECORD = struct(external_id=S, full_name=S, family_name=S, sur_name=S, source=S, pattern_used=S)
PHOTOS = struct(path=S, name=S, length=L, modified=T.TimestampType())
MANIFEST = T.MapType(S, T.MapType(S, S))
MAPPING_RESULT = struct(PlayerId=I, External_Player_ID=S, PhotoFileName=S, Confidence=D, ConfidenceThreshold=D, ModelUsed=S, Method=S, ProcessingTimeMs=L, Metadata=T.MapType(S, S))
POINT = struct(x=I, y=I)
RECT = struct(x=I, y=I, width=I, height=I)
LANDMARKS = struct(face_detected=B, face=RECT, left_eye=POINT, right_eye=POINT, model_used=S, confidence=D, processing_ms=L, metadata=T.MapType(S, S))
CACHE_ENTRY = struct(ImagePath=S, FileSize=L, LastModified=T.TimestampType(), Landmarks=LANDMARKS, Model=S)
VARIANT = struct(key=S, width=I, height=I, outputSubfolder=S, placeholderPath=S)
TEST_ROW = struct(name1=S, name2=S, expected=B, predicted=B, confidence=D, processingTimeMs=L)
MODEL_RESULT = struct(modelName=S, startTime=S, endTime=S, durationMs=L, testCount=I, correct=I, accuracy=D, averageProcessingTimeMs=D, averageConfidence=D, error=S, testResults=T.ArrayType(TEST_ROW))
BENCHMARK = struct(timestamp=S, testDataPath=S, nameMatchingResults=T.ArrayType(MODEL_RESULT), faceDetectionResults=T.ArrayType(MODEL_RESULT))
TEAM_RESULT = struct(TeamId=I, TeamName=S, Status=S, PlayersExtracted=I, PlayersMapped=I, UnmappedPlayers=T.ArrayType(S), Error=S)

METHODS = ("DirectIdMatch", "AiNameMatching", "Manual", "NoMatch")
STATUSES = ("Pending", "Completed", "Failed", "Skipped")

#: The deterministic gate: how far the best name must be ahead, and the score from which that doesn't matter.
MARGIN, SURE = 0.07, 0.98
#: The same for scorers, from which confidence on a lead isn't needed.
SCORER_SURE = 0.90
#: The lead under which the best two of many count as too close.
CLOSE = 0.07
#: Pairs that one scorer call takes.
BATCH = 24
#: Shortlists of the scorer's passes: candidates, least score, or distance to the best; and the margin asked for.
PASSES = ({"k": 8, "least": 0.40, "gap": 0.30, "margin": 0.08}, {"k": 12, "least": 0.25, "gap": 0.40, "margin": 0.05})
CLI_FLOOR, UI_FLOOR = 0.80, 0.65
