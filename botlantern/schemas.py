"""Fixed schemas and primary keys of the stored tables."""

from __future__ import annotations

MESSAGE = "date int, hour int, type string, selfId string, platform string, count long"
COMMAND = "date int, hour int, name string, selfId string, userId long, channelId string, platform string, count long"
USER_PROFILE = "userId long, platform string, platformUserId string, userName string, updatedAt timestamp"
AI_REQUEST = (
    "id string, timestamp timestamp, date int, hour int, source string, provider string, modelId string, userId string, platform string, "
    "channelId string, guildId string, promptTokens long, completionTokens long, totalTokens long, latencyMs long, firstTokenLatencyMs long, "
    "success boolean, errorCode string, fallbackFrom string, logFile string, logOffset long"
)
AI_MODEL_DAILY = (
    "date int, source string, provider string, modelId string, requestCount long, successCount long, failCount long, "
    "promptTokens long, completionTokens long, totalTokens long, totalLatencyMs long"
)
IMAGE_GENERATION = (
    "id string, timestamp timestamp, date int, hour int, userId string, platform string, commandName string, styleName string, modelId string, "
    "provider string, numImages long, success boolean, freeUsed long, purchasedUsed long, consumptionType string, errorCode string, latencyMs long, logFile string, logOffset long"
)
LOG_OFFSET_V2 = "fileName string, size long, lastOffset long, updatedAt timestamp"
LOG_OFFSET = "fileName string, size long, lastOffset long, mtimeMs long, updatedAt timestamp"
DIRTY_DATE = "date int, updatedAt timestamp"
IMPORT_STATE = (
    "key string, status string, cursorFileName string, processedFiles long, processedBytes long, importedAiRecords long, importedImageRecords long, "
    "startedAt timestamp, updatedAt timestamp, completedAt timestamp, failedAt timestamp, nextRetryAt timestamp, consecutiveFailures long, lastError string"
)

#: The log line that a record was made of, null for others. Calls of one millisecond may share an id, and lines that are read again keep their place.
PLACE = ["logFile", "logOffset"]

PRIMARY_KEYS = {
    "message": ["date", "hour", "type", "selfId", "platform"],
    "command": ["date", "hour", "name", "selfId", "userId", "channelId", "platform"],
    "user_profile": ["userId"],
    "ai_request": ["id", *PLACE],
    "ai_model_daily": ["date", "source", "provider", "modelId"],
    "image_generation": ["id", *PLACE],
    "log_offset": ["fileName"],
    "log_offset_v2": ["fileName"],
    "ai_daily_dirty": ["date"],
    "log_import_state": ["key"],
}
