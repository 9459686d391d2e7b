"""Names that protocol specifications and registries give to numbers and letters."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _numbered(text: str, start: int = 0) -> dict[int, str]:
    return dict(enumerate(text.split(), start))


#: DNS record types, response codes, classes and operations.
DNS_TYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV"}
DNS_RCODES = _numbered("Success FormatError ServerFailure NameError NotImplemented Refused")
DNS_CLASSES = {1: "INET", 2: "CSNET", 3: "CHAOS", 4: "HESIOD", 255: "ANY"}
DNS_OPERATIONS = _numbered("Query IQuery Status")
#: MySQL commands.
MYSQL_COMMANDS = _numbered(
    "QUIT INIT_DB QUERY FIELD_LIST CREATE_DB DROP_DB REFRESH SHUTDOWN STATISTICS PROCESS CONNECT KILL DEBUG PING TIME DELAYED CHANGE_USER BINLOG_DUMP TABLE_DUMP CONNECT_OUT REGISTER PREPARE EXECUTE "
    "SEND_LONG_DATA CLOSE_STMT RESET_STMT SET_OPTION FETCH_STMT DAEMON BINLOG_DUMP_GTID RESET_CONNECTION",
    1,
)
#: MongoDB operations, and the codes that servers send most.
MONGO_OPCODES = {1: "REPLY", 2001: "UPDATE", 2002: "INSERT", 2003: "RESERVED", 2004: "QUERY", 2005: "GET_MORE", 2006: "DELETE", 2007: "KILL_CURSORS", 2012: "COMPRESSED", 2013: "MSG"}
MONGO_CODES = {
    0: "OK", 1: "InternalError", 2: "BadValue", 4: "NoSuchKey", 6: "HostUnreachable", 7: "HostNotFound", 8: "UnknownError", 9: "FailedToParse", 11: "UserNotFound", 13: "Unauthorized", 14: "TypeMismatch",
    15: "Overflow", 16: "InvalidLength", 17: "ProtocolError", 18: "AuthenticationFailed", 20: "IllegalOperation", 22: "InvalidBSON", 24: "LockTimeout", 26: "NamespaceNotFound", 27: "IndexNotFound",
    43: "CursorNotFound", 48: "NamespaceExists", 50: "MaxTimeMSExpired", 59: "CommandNotFound", 66: "ImmutableField", 67: "CannotCreateIndex", 72: "InvalidOptions", 73: "InvalidNamespace",
    85: "IndexOptionsConflict", 86: "IndexKeySpecsConflict", 89: "NetworkTimeout", 91: "ShutdownInProgress", 96: "OperationFailed", 112: "WriteConflict", 121: "DocumentValidationFailure",
    189: "PrimarySteppedDown", 251: "NoSuchTransaction", 262: "ExceededTimeLimit", 10107: "NotWritablePrimary", 11000: "DuplicateKey", 11600: "InterruptedAtShutdown", 11601: "Interrupted",
    11602: "InterruptedDueToReplStateChange", 13435: "NotPrimaryNoSecondaryOk",
}
#: Commands of MongoDB servers, those whose value is the name of a collection first.
MONGO_COLLECTION_COMMANDS = frozenset(
    "aggregate cloneCollectionAsCapped collMod collStats compact convertToCapped count create createIndexes createSearchIndexes delete distinct drop dropIndexes dropSearchIndex find findAndModify findandmodify "
    "geoSearch insert killCursors listIndexes listSearchIndexes mapReduce mapreduce planCacheClear planCacheClearFilters planCacheListFilters planCacheSetFilter reIndex update updateSearchIndex validate".split()
)
MONGO_COMMANDS = MONGO_COLLECTION_COMMANDS | frozenset(
    "abortTransaction abortReshardCollection addShard addShardToZone analyze analyzeShardKey applyOps authenticate autoCompact balancerCollectionStatus balancerStart balancerStatus balancerStop buildInfo buildinfo bulkWrite "
    "changePrimary checkShardingIndex cleanupOrphaned cleanupReshardCollection clearJumboFlag cloneCollection commitReshardCollection commitTransaction compactStructuredEncryptionData configureCollectionBalancing "
    "configureQueryAnalyzer connPoolStats connPoolSync connectionStatus createRole createUser currentOp cursorInfo dataSize dbHash dbStats driverOIDTest dropAllRolesFromDatabase dropAllUsersFromDatabase dropConnections "
    "dropDatabase dropRole dropUser enableSharding endSessions explain features filemd5 flushRouterConfig fsync fsyncUnlock getAuditConfig getClusterParameter getCmdLineOpts getDefaultRWConcern getLastError getLog getMore "
    "getParameter getShardMap getShardVersion getnonce grantPrivilegesToRole grantRolesToRole grantRolesToUser hello hostInfo invalidateUserCache isMaster isdbgrid ismaster killAllSessions killAllSessionsByPattern "
    "killOp killSessions listCollections listCommands listDatabases listShards lockInfo logApplicationMessage logRotate logout medianKey mergeAllChunksOnShard mergeChunks moveChunk moveCollection movePrimary moveRange "
    "netstat ping profile refineCollectionShardKey refreshSessions removeShard removeShardFromZone renameCollection replSetAbortPrimaryCatchUp replSetFreeze replSetGetConfig replSetGetStatus replSetInitiate "
    "replSetMaintenance replSetReconfig replSetResizeOplog replSetStepDown replSetSyncFrom reshardCollection resync revokePrivilegesFromRole revokeRolesFromRole revokeRolesFromUser rolesInfo rotateCertificates "
    "saslContinue saslStart serverStatus setAllowMigrations setAuditConfig setClusterParameter setDefaultRWConcern setFeatureCompatibilityVersion setIndexCommitQuorum setParameter setShardVersion shardCollection "
    "shardConnPoolStats shardingState shutdown split splitChunk splitVector startSession top transitionFromDedicatedConfigServer transitionToDedicatedConfigServer unshardCollection unsetSharding untrackUnshardedCollection "
    "updateRole updateUser updateZoneKeyRange usersInfo validateDBMetadata waitForFailPoint whatsmyuri whatsMyUri".split()
)
#: What the first letter of a PostgreSQL message means, from clients and from servers.
POSTGRES_CLIENT = {
    "B": "Bind", "C": "Close", "d": "CopyData", "c": "CopyDone", "f": "CopyFail", "D": "Describe", "E": "Execute", "H": "Flush", "F": "FunctionCall", "P": "Parse", "p": "PasswordMessage", "Q": "Query", "S": "Sync",
    "X": "Terminate",
}
POSTGRES_SERVER = {
    "R": "Authentication", "K": "BackendKeyData", "2": "BindComplete", "3": "CloseComplete", "C": "CommandComplete", "d": "CopyData", "c": "CopyDone", "G": "CopyInResponse", "H": "CopyOutResponse",
    "W": "CopyBothResponse", "D": "DataRow", "I": "EmptyQueryResponse", "E": "ErrorResponse", "V": "FunctionCallResponse", "v": "NegotiateProtocolVersion", "n": "NoData", "N": "NoticeResponse",
    "A": "NotificationResponse", "t": "ParameterDescription", "S": "ParameterStatus", "1": "ParseComplete", "s": "PortalSuspended", "Z": "ReadyForQuery", "T": "RowDescription",
}
#: Kafka requests and errors.
KAFKA_APIS = {
    **_numbered(
        "Produce Fetch ListOffsets Metadata LeaderAndIsr StopReplica UpdateMetadata ControlledShutdown OffsetCommit OffsetFetch FindCoordinator JoinGroup Heartbeat LeaveGroup SyncGroup DescribeGroups "
        "ListGroups SaslHandshake ApiVersions CreateTopics DeleteTopics DeleteRecords InitProducerId OffsetForLeaderEpoch AddPartitionsToTxn AddOffsetsToTxn EndTxn WriteTxnMarkers TxnOffsetCommit "
        "DescribeAcls CreateAcls DeleteAcls DescribeConfigs AlterConfigs AlterReplicaLogDirs DescribeLogDirs SaslAuthenticate CreatePartitions CreateDelegationToken RenewDelegationToken "
        "ExpireDelegationToken DescribeDelegationToken DeleteGroups ElectLeaders IncrementalAlterConfigs AlterPartitionReassignments ListPartitionReassignments OffsetDelete DescribeClientQuotas "
        "AlterClientQuotas DescribeUserScramCredentials AlterUserScramCredentials Vote BeginQuorumEpoch EndQuorumEpoch DescribeQuorum AlterPartition UpdateFeatures Envelope"
    ),
    60: "DescribeCluster",
    61: "DescribeProducers",
    65: "DescribeTransactions",
    66: "ListTransactions",
    67: "AllocateProducerIds",
}
KAFKA_ERRORS = _numbered(
    "UnknownServerError NoError OffsetOutOfRange CorruptMessage UnknownTopicOrPartition InvalidFetchSize LeaderNotAvailable NotLeaderOrFollower RequestTimedOut BrokerNotAvailable ReplicaNotAvailable "
    "MessageSizeTooLarge StaleControllerEpoch OffsetMetadataTooLarge NetworkException CoordinatorLoadInProgress CoordinatorNotAvailable NotCoordinator InvalidTopicException RecordListTooLarge "
    "NotEnoughReplicas NotEnoughReplicasAfterAppend InvalidRequiredAcks IllegalGeneration InconsistentGroupProtocol InvalidGroupId UnknownMemberId InvalidSessionTimeout RebalanceInProgress "
    "InvalidCommitOffsetSize TopicAuthorizationFailed GroupAuthorizationFailed ClusterAuthorizationFailed InvalidTimestamp UnsupportedSASLMechanism IllegalSASLState UnsupportedVersion TopicAlreadyExists "
    "InvalidPartitions InvalidReplicationFactor InvalidReplicaAssignment InvalidConfig NotController InvalidRequest UnsupportedForMessageFormat PolicyViolation OutOfOrderSequenceNumber "
    "DuplicateSequenceNumber InvalidProducerEpoch InvalidTxnState InvalidProducerIDMapping InvalidTransactionTimeout ConcurrentTransactions TransactionCoordinatorFenced "
    "TransactionalIDAuthorizationFailed SecurityDisabled OperationNotAttempted KafkaStorageError LogDirNotFound SASLAuthenticationFailed UnknownProducerID ReassignmentInProgress "
    "DelegationTokenAuthDisabled DelegationTokenNotFound DelegationTokenOwnerMismatch DelegationTokenRequestNotAllowed DelegationTokenAuthorizationFailed DelegationTokenExpired InvalidPrincipalType "
    "NonEmptyGroup GroupIDNotFound FetchSessionIDNotFound InvalidFetchSessionEpoch ListenerNotFound TopicDeletionDisabled FencedLeaderEpoch UnknownLeaderEpoch UnsupportedCompressionType StaleBrokerEpoch "
    "OffsetNotAvailable MemberIdRequired PreferredLeaderNotAvailable GroupMaxSizeReached FencedInstanceId EligibleLeadersNotAvailable ElectionNotNeeded NoReassignmentInProgress GroupSubscribedToTopic "
    "InvalidRecord UnstableOffsetCommit ThrottlingQuotaExceeded ProducerFenced ResourceNotFound DuplicateResource UnacceptableCredential InconsistentVoterSet InvalidUpdateVersion FeatureUpdateFailed "
    "PrincipalDeserializationFailure SnapshotNotFound PositionOutOfRange UnknownTopicID DuplicateBrokerRegistration BrokerIDNotRegistered InconsistentTopicID InconsistentClusterID "
    "TransactionalIDNotFound FetchSessionTopicIDError",
    -1,
)
#: AMQP classes, their methods, and reply codes.
AMQP_CLASSES = {10: "Connection", 20: "Channel", 40: "Exchange", 50: "Queue", 60: "Basic", 85: "Confirm", 90: "Tx"}
AMQP_METHODS = {
    10: {10: "Start", 11: "Start-Ok", 20: "Secure", 21: "Secure-Ok", 30: "Tune", 31: "Tune-Ok", 40: "Open", 41: "Open-Ok", 50: "Close", 51: "Close-Ok"},
    20: {10: "Open", 11: "Open-Ok", 20: "Flow", 21: "Flow-Ok", 40: "Close", 41: "Close-Ok"},
    40: {10: "Declare", 11: "Declare-Ok", 20: "Delete", 21: "Delete-Ok"},
    50: {10: "Declare", 11: "Declare-Ok", 20: "Bind", 21: "Bind-Ok", 30: "Purge", 31: "Purge-Ok", 40: "Delete", 41: "Delete-Ok", 50: "Unbind", 51: "Unbind-Ok"},
    60: {10: "Qos", 11: "Qos-Ok", 20: "Consume", 21: "Consume-Ok", 30: "Cancel", 31: "Cancel-Ok", 40: "Publish", 50: "Return", 60: "Deliver", 70: "Get", 71: "Get-Ok", 72: "Get-Empty", 80: "Ack", 90: "Reject",
         100: "Recover", 101: "Recover-Ok", 120: "Nack"},
    85: {10: "Select", 11: "Select-Ok"},
    90: {10: "Select", 11: "Select-Ok", 20: "Commit", 21: "Commit-Ok", 30: "Rollback", 31: "Rollback-Ok"},
}
AMQP_ERRORS = {
    0: "OK", 311: "CONTENT_TOO_LARGE", 312: "NO_ROUTE", 313: "NO_CONSUMERS", 403: "ACCESS_REFUSED", 404: "NOT_FOUND", 406: "PRECONDITION_FAILED", 501: "FRAME_ERROR", 502: "SYNTAX_ERROR",
    503: "COMMAND_INVALID", 504: "CHANNEL_ERROR", 505: "UNEXPECTED_FRAME",
}
#: HTTP/2 frames, first bytes of Redis values, and Redis commands whose next word says what they do.
HTTP2_FRAMES = _numbered("DATA HEADERS PRIORITY RST_STREAM SETTINGS PUSH_PROMISE PING GOAWAY WINDOW_UPDATE CONTINUATION")
REDIS_TYPES = {"*": "Array", "$": "BulkString", "+": "SimpleString", "-": "Error", ":": "Integer"}
REDIS_CONTAINERS = tuple("ACL CLIENT CLUSTER COMMAND CONFIG DEBUG FUNCTION LATENCY MEMORY MODULE OBJECT PUBSUB SCRIPT SENTINEL SLOWLOG XGROUP XINFO".split())


def look_up(of: Column, table: Mapping, other: Column | None = None) -> Column:
    """The name of a number or letter; ``other`` (the number as text, if none is given) where there is none."""
    key = of.cast("int") if all(isinstance(k, int) for k in table) else of
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], of.cast("string") if other is None else other)
