"""Ordinary log lines, two or more per leaf of the default taxonomy, labelled by hand."""

LINES = {
    "ERROR.connection_failure": [
        "dial tcp 10.2.0.17:6379: connect: connection refused",
        "curl: (6) Could not resolve host: db.internal, dns lookup failed",
        "read tcp 172.17.0.4:51322->172.17.0.9:443: connection reset by peer"],
    "ERROR.auth_failure": [
        "401 Unauthorized: token signature mismatch",
        "authentication failed: bad credentials for service account"],
    "ERROR.authorization_failure": [
        "403 Forbidden: insufficient privileges to list buckets",
        "permission denied for relation invoices"],
    "ERROR.timeout": [
        "rpc error: context deadline exceeded",
        "upstream request timed out waiting for response after 30s"],
    "ERROR.runtime_exception": [
        "panic: runtime error: invalid memory address or nil pointer dereference",
        "Traceback (most recent call last): TypeError: unsupported operand",
        "Unhandled exception: java.lang.NullPointerException at line 88"],
    "ERROR.validation_error": [
        "validation failed: field 'email' is required",
        "invalid value for parameter limit: must be a positive integer"],
    "ERROR.out_of_memory": [
        "java.lang.OutOfMemoryError: Java heap space",
        "Memory cgroup out of memory: Killed process 4711 (node)"],
    "ERROR.rate_limited": [
        "HTTP 429 Too Many Requests, retry after 12s",
        "ThrottlingException: quota of requests exhausted, slow down"],
    "ERROR.dependency_error": [
        "no healthy upstream for payment provider",
        "circuit open: dependency inventory-api unavailable, using fallback"],
    "REQUEST.success": [
        "GET /api/v1/users 200 OK 12ms",
        "POST /orders 201 Created"],
    "REQUEST.client_error": [
        "GET /favicon.ico HTTP/1.1 404 Not Found",
        "POST /login 400 Bad Request: client sent malformed JSON"],
    "REQUEST.server_error": [
        "GET /checkout HTTP/1.1 500 Internal Server Error",
        "502 Bad Gateway while proxying to backend"],
    "REQUEST.redirect": [
        "GET /old-path 301 Moved Permanently",
        "302 Found, redirect location /login"],
    "REQUEST.slow_request": [
        "slow request: GET /report took 8.2 seconds",
        "http handler duration 5100ms exceeds threshold"],
    "DEPLOY.build_started": [
        "Build started for commit 9f3c2a1",
        "ci job triggered, building image web:1.4"],
    "DEPLOY.build_succeeded": [
        "Build succeeded in 94s, artifact pushed",
        "webpack compiled successfully, all tests passed"],
    "DEPLOY.build_failed": [
        "make: *** [all] Error 1: could not compile",
        "npm ERR! code 2, build failure"],
    "DEPLOY.deploy_started": [
        "Starting deployment of api version 2.3.0 to production",
        "rolling out release 2024.11 to staging"],
    "DEPLOY.deploy_succeeded": [
        "deployment complete, version 2.3.0 is live",
        "deployment web successfully rolled out"],
    "DEPLOY.deploy_failed": [
        "deploy failed: rollout stuck, progress deadline exceeded",
        "deployment api aborted after error"],
    "DEPLOY.rollback": [
        "rolling back to previous version 2.2.9",
        "release reverted to v41, rollback done"],
    "SYSTEM.health_check": [
        "readiness probe failed: /healthz returned 503",
        "GET /healthz liveness check passing"],
    "SYSTEM.scaling_event": [
        "HPA scaled web from 3 to 8 replicas",
        "autoscaler removed 2 nodes"],
    "SYSTEM.resource_alert": [
        "disk usage at 93 percent on /var",
        "CPU above threshold: 97 percent load"],
    "SYSTEM.process_lifecycle": [
        "server listening on port 8080",
        "received SIGTERM, stopping gracefully, pid 12"],
    "SYSTEM.config_change": [
        "SIGHUP received, reloading configuration",
        "feature flag new-checkout toggled on"],
    "ACCESS.login_success": [
        "user alice logged in via sso",
        "login successful, session created for uid 1001"],
    "ACCESS.login_failure": [
        "sshd[811]: Failed password for invalid user admin from 198.51.100.7 port 40022 ssh2",
        "login attempt rejected: wrong pin"],
    "ACCESS.session_expired": [
        "session cookie expired, user logged out",
        "jwt expired: exp claim passed"],
    "ACCESS.permission_change": [
        "role admin granted to bob by carol",
        "group membership of dave changed, access revoked by admin"],
    "ACCESS.api_key_event": [
        "api key rotated for project billing",
        "personal access token revoked"],
    "PERFORMANCE.latency_spike": [
        "p99 latency increased to 2400 ms",
        "latency above baseline, p95 degraded"],
    "PERFORMANCE.throughput_drop": [
        "throughput dropped to 120 requests per second",
        "traffic fell below expected rate: 40 rps"],
    "PERFORMANCE.queue_backlog": [
        "kafka consumer lag growing: 120k messages pending",
        "queue depth 5000, workers waiting"],
    "PERFORMANCE.cache_event": [
        "cache miss for key session:77",
        "redis evicted 310 keys, hit ratio 0.71"],
    "PERFORMANCE.db_slow_query": [
        "slow query: SELECT * FROM orders took 4100 ms",
        "long running sql execution: table scan on events took 95 seconds"],
    "DATA.query_executed": [
        "statement execute: insert into carts, 3 rows affected",
        "LOG: execute prepared statement, 12 rows returned"],
    "DATA.migration": [
        "migration 0042 applied: alter table users add column locale",
        "schema migrated up to version 17"],
    "DATA.replication": [
        "standby started streaming WAL from primary",
        "replica caught up with binlog position 99120"],
    "SCHEDULED.cron_started": [
        "nightly scheduled task triggered",
        "cron job backup started"],
    "SCHEDULED.cron_completed": [
        "scheduled task cleanup finished successfully in 12s",
        "cron job report completed, processed 900 records"],
    "SCHEDULED.cron_failed": [
        "cron job backup failed with nonzero exit status",
        "airflow dag run failed: scheduled job missed"],
}

#: Messages as widely used software prints them, taken down without regard to the label words.
FOREIGN_LINES = {
    "ERROR.connection_failure": ["java.net.ConnectException: Connection refused (Connection refused)",
                                 "psql: error: connection to server at \"localhost\" (127.0.0.1), port 5432 failed: Connection refused",
                                 "Error: getaddrinfo ENOTFOUND api.example.com", "ssh: connect to host 10.0.0.9 port 22: No route to host"],
    "ERROR.auth_failure": ["FATAL: password authentication failed for user \"app\"", "invalid_token: The access token is invalid"],
    "ERROR.authorization_failure": ["AccessDenied: User is not authorized to perform: s3:GetObject", "open /etc/shadow: permission denied",
                                    "pods is forbidden: User \"system:anonymous\" cannot list resource \"pods\""],
    "ERROR.timeout": ["net/http: request canceled (Client.Timeout exceeded while awaiting headers)", "java.net.SocketTimeoutException: Read timed out",
                      "canceling statement due to statement timeout"],
    "ERROR.runtime_exception": ["Uncaught TypeError: Cannot read properties of undefined (reading 'map')", "Segmentation fault (core dumped)",
                                "thread 'main' panicked at src/main.rs:4:5: index out of bounds"],
    "ERROR.out_of_memory": ["FATAL ERROR: Reached heap limit Allocation failed - JavaScript heap out of memory", "Last State: Terminated, Reason: OOMKilled, Exit Code: 137"],
    "REQUEST.success": ["127.0.0.1 - - [10/Oct/2023:13:55:36 +0000] \"GET /index.html HTTP/1.1\" 200 2326"],
    "REQUEST.client_error": ["192.0.2.4 - - [10/Oct/2023:13:55:36 +0000] \"GET /wp-login.php HTTP/1.1\" 404 153"],
    "REQUEST.server_error": ["192.0.2.4 - - [10/Oct/2023:13:55:36 +0000] \"POST /api HTTP/1.1\" 502 157"],
    "DEPLOY.build_failed": ["error: failed to compile: process completed with exit code 101", "BUILD FAILURE", "make: *** [Makefile:12: all] Error 2"],
    "DEPLOY.deploy_succeeded": ["deployment \"web\" successfully rolled out"],
    "SYSTEM.health_check": ["Liveness probe failed: HTTP probe failed with statuscode: 503"],
    "SYSTEM.scaling_event": ["Scaled up replica set web-7d4b9c to 5"],
    "SYSTEM.process_lifecycle": ["systemd[1]: Started nginx.service.", "Listening on http://0.0.0.0:3000", "database system is ready to accept connections"],
    "ACCESS.login_success": ["Accepted publickey for deploy from 203.0.113.9 port 50022 ssh2", "session opened for user root by (uid=0)"],
    "ACCESS.login_failure": ["Failed password for root from 203.0.113.5 port 22 ssh2", "pam_unix(sshd:auth): authentication failure; rhost=203.0.113.5"],
    "ACCESS.session_expired": ["TokenExpiredError: jwt expired"],
    "PERFORMANCE.db_slow_query": ["duration: 5003.112 ms statement: SELECT pg_sleep(5)"],
    "PERFORMANCE.cache_event": ["X-Cache: MISS from cloudfront"],
    "DATA.migration": ["Migrating database to 20231010_add_users", "Applying auth.0001_initial... OK"],
    "DATA.replication": ["started streaming WAL from primary at 0/3000000 on timeline 1"],
    "SCHEDULED.cron_started": ["CRON[2112]: (root) CMD (run-parts /etc/cron.hourly)"],
}
