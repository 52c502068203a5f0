"""Errors by code. Codes are those of the public Kafka protocol where it has one."""

from __future__ import annotations


class LogError(Exception):
    """What went wrong, with a stable code."""

    code = "STORAGE_ERROR"

    def __init__(self, message: str = "", code: str | None = None):
        super().__init__(message or self.code)
        self.code = code or self.code


class InvalidName(LogError):
    code = "INVALID_TOPIC_EXCEPTION"


class UnknownTopicOrPartition(LogError):
    code = "UNKNOWN_TOPIC_OR_PARTITION"


class OutOfOrderSequence(LogError):
    code = "OUT_OF_ORDER_SEQUENCE_NUMBER"


class InvalidProducerEpoch(LogError):
    code = "INVALID_PRODUCER_EPOCH"


class ConflictingSequence(LogError):
    code = "INVALID_RECORD"


class InvalidRequest(LogError):
    code = "INVALID_REQUEST"


class UnsupportedRecord(LogError):
    code = "UNSUPPORTED_FOR_MESSAGE_FORMAT"


class InvalidTimestamp(LogError):
    code = "INVALID_TIMESTAMP"


class OffsetOutOfRange(LogError):
    code = "OFFSET_OUT_OF_RANGE"


class MessageTooLarge(LogError):
    code = "MESSAGE_TOO_LARGE"


class CorruptMessage(LogError):
    code = "CORRUPT_MESSAGE"


class Contention(LogError):
    code = "STORAGE_ERROR"


class MaintenanceIncomplete(LogError):
    """A published retention whose clean-up didn't finish; report has what is confirmed."""

    code = "STORAGE_ERROR"

    def __init__(self, message: str, report: dict):
        super().__init__(message)
        self.report = report


class UnknownMember(LogError):
    code = "UNKNOWN_MEMBER_ID"


class IllegalGeneration(LogError):
    code = "ILLEGAL_GENERATION"


class RebalanceInProgress(LogError):
    code = "REBALANCE_IN_PROGRESS"


class InvalidSessionTimeout(LogError):
    code = "INVALID_SESSION_TIMEOUT"


class InconsistentProtocol(LogError):
    code = "INCONSISTENT_GROUP_PROTOCOL"
